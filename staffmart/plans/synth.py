"""Test data of any size, made on the executors.

Every random value is a function of (seed, row number, purpose), so rows do not depend on
partitioning and a retried task makes the same ones again. A row's profile holds all that
its assignments, reviews and history need, so those are column expressions and no joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.functions.numbers import (
    between, clip, draw, normal, pick, pick_weighted, safe_float, safe_int, words)
from staffmart.functions.text import is_blank, matches, numbered
from staffmart.operators.ordering import with_position
from staffmart.plans.synth_values import (
    DEPARTMENTS, FIRST_NAMES, GENDERS, LAST_NAMES, LEAVER_STATUS, PROJECT_STATUS, PROJECTS,
    REVIEW_YEARS, ROLES, SEED_ATTRITION, SEED_RATINGS)
from staffmart.schemas import (
    ASSIGNMENTS, DEPARTMENTS as DEPARTMENT_SCHEMA, EMPLOYEE_HISTORY, EMPLOYEES_FILE, MONEY,
    PROJECTS as PROJECT_SCHEMA, REVIEWS, SCORE, SEED)
from staffmart.sources.tables import exists, materialise, read_csv

SEED_ROWS = 1470  # fixed value: rows of the seed that is made when there is no file
ROLE_NAMES = [role for role, _ in ROLES]
DEPARTMENT_NAMES = [d[1] for d in DEPARTMENTS]
POINT = 10_000  # scores are computed in ten-thousandths of a point
TYPICAL = {d[0]: d[4] * POINT for d in DEPARTMENTS}


def load_seed(spark: SparkSession, path: str | None = None, seed: int = 42) -> DataFrame:
    """The seed file, or a made seed with the same columns if there is none."""
    if path and exists(spark, path):
        return read_csv(spark, path, SEED)
    rows = spark.range(SEED_ROWS).select("id", *words(seed, F.concat(F.lit("seed"), F.col("id"))))
    rows = rows.withColumn("Age", between("age", 21, 60))
    return rows.select(
        (F.col("id") + 1001).alias("EmployeeNumber"),
        "Age",
        pick("gender", GENDERS).alias("Gender"),
        pick("department", DEPARTMENT_NAMES).alias("Department"),
        pick("role", ROLE_NAMES).alias("JobRole"),
        between("income", 25000, 220000).alias("MonthlyIncome"),
        (draw("years") % (F.least(F.lit(25), F.col("Age") - 18) + 1)).alias("YearsAtCompany"),
        between("level", 1, 5).alias("JobLevel"),
        pick("rating", SEED_RATINGS).alias("PerformanceRating"),
        pick("attrition", SEED_ATTRITION).alias("Attrition"),
    ).select(*[F.col(f.name).cast("string").alias(f.name) for f in SEED])


def _choose(key: Column, values: dict, default=None) -> Column:
    """Value for the key, from a constant map."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _first_of_year(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def _day_between(low: Column, high: Column, purpose: str) -> Column:
    """Uniform day from low to high."""
    return F.date_add(low, (draw(purpose) % F.greatest(F.lit(1), F.datediff(high, low) + 1)).cast("int"))


def _rotated(department_id: Column) -> Column:
    return F.pmod(department_id, F.lit(len(DEPARTMENTS))) + 1


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(15,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


@dataclass
class Generator:
    """``rows`` employees scaled out from a seed table, and everything around them."""

    spark: SparkSession
    seed_table: DataFrame
    rows: int
    seed: int = 42
    min_rows: int = 0

    def __post_init__(self):
        self.rows = max(self.rows, self.min_rows)
        self.with_past = max(1, self.rows // 10)
        self.second_share = 35
        self._profile: DataFrame | None = None

    # --- one row per employee ---------------------------------------------------------

    def profile(self) -> DataFrame:
        """Employee i (from 0) takes seed row i modulo the size of the seed.

        Written once to the shared folder: all tables are made from it.
        """
        if self._profile is None:
            self._profile = materialise(self._build_profile(), "profile")
        return self._profile

    def _build_profile(self) -> DataFrame:
        numbered_seed = with_position(
            self.seed_table, "place", [safe_int(F.col("EmployeeNumber")), "EmployeeNumber"])
        size = self.seed_table.count()
        rows = (self.spark.range(self.rows).withColumnRenamed("id", "i")
                .select("i", (F.col("i") % size + 1).alias("place"), *words(self.seed, F.col("i")))
                .join(numbered_seed, "place"))
        has_past = F.col("i") < self.with_past

        department = F.when(F.col("Department").isin(DEPARTMENT_NAMES), F.col("Department")).otherwise(
            pick("department", DEPARTMENT_NAMES))
        role = F.when(is_blank(F.col("JobRole")) | (F.col("JobRole") == "nan"),
                      pick("role", ROLE_NAMES)).otherwise(F.col("JobRole"))
        income = safe_float(F.col("MonthlyIncome"), between("income", 30000, 180000))
        rows = rows.select(
            "i", "w0", "w1",
            numbered("E", F.col("i") + 1, 6).alias("employee_id"),
            pick("first name", FIRST_NAMES).alias("first_name"),
            pick("last name", LAST_NAMES).alias("last_name"),
            F.coalesce("Gender", pick("gender", GENDERS)).alias("gender"),
            clip(safe_int(F.col("Age"), between("age", 22, 55)), 21, 65).alias("age"),
            clip(safe_int(F.col("YearsAtCompany"), between("years", 0, 15)), 0, 35).alias("years"),
            department.alias("department_name"),
            role.alias("role"),
            F.round(income * 1200).cast("long").alias("cents"),
            F.when(F.coalesce(F.col("Attrition"), F.lit("No")) == "Yes", pick("leaver", LEAVER_STATUS))
            .otherwise("Active").alias("status"))

        hire_year = clip(2026 - F.col("years") - between("hire year", 0, 5), 1995, 2025)
        effects = {role_: tenths * POINT // 10 for role_, tenths in ROLES}
        rows = rows.withColumns({
            "department_id": _choose(F.col("department_name"), {d[1]: d[0] for d in DEPARTMENTS}),
            # yearly pay under 240,000 is replaced by a drawn monthly income
            "salary_cents": F.when(F.col("cents") < 240000_00, between("pay", 30000, 180000) * 1200)
            .otherwise(F.col("cents")),
            "hire_year": F.when(has_past, F.least(hire_year, F.lit(2022))).otherwise(hire_year).cast("int"),
            "role_effect": _choose(F.col("role"), effects, 0),
        })
        last_year = F.greatest("hire_year", F.when(has_past, 2023).otherwise(2025))
        weights = [share for _, share in PROJECTS]
        rows = rows.withColumns({
            "hire_date": _day_between(_first_of_year(F.col("hire_year")),
                                      F.date_sub(_first_of_year(last_year + 1), 1), "hire day"),
            "project": pick_weighted("project", weights),
            "second_project": F.when(draw("has second") % 100 < self.second_share,
                                     pick_weighted("second project", weights)),
            "base": clip(_choose(F.col("department_id"), TYPICAL) + F.col("role_effect")
                         + normal("base", 5 * POINT), 45 * POINT, 95 * POINT),
        })
        past_start = F.least(
            F.date_add("hire_date", clip(between("past start", 30, 899), 30, 500).cast("int")),
            F.lit("2024-06-01").cast("date"))
        rows = rows.withColumns({
            "past_start": F.when(has_past, past_start),
            "past_department_id": F.when(has_past, _rotated(F.col("department_id"))),
            "past_role": F.when(has_past, pick("past role", ROLE_NAMES)),
            "pay_share": F.when(has_past, between("pay share", 7800, 9200)),
        })
        return rows.drop("years", "cents", "hire_year")

    # --- tables -----------------------------------------------------------------------

    def departments(self) -> DataFrame:
        rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(d, DEPARTMENT_SCHEMA.names)]) for d in DEPARTMENTS]
        return (self.spark.range(1).select(F.explode(F.array(*rows)).alias("d")).select("d.*")
                .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DEPARTMENT_SCHEMA]))

    def projects(self) -> DataFrame:
        names = self.spark.range(1).select(
            F.posexplode(F.array(*[F.lit(name) for name, _ in PROJECTS])).alias("i", "project_name"))
        names = names.select("*", *words(self.seed, F.concat(F.lit("project"), F.col("i"))))
        start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("i") * 45).cast("int"))
        return names.select(
            numbered("P", F.col("i") + 1, 4).alias("project_id"), "project_name",
            F.concat(F.lit("Enterprise initiative: "), "project_name").alias("description"),
            start.alias("start_date"),
            F.date_add(start, between("length", 180, 540).cast("int")).alias("end_date"),
            pick("status", PROJECT_STATUS).alias("status"),
        ).select(*PROJECT_SCHEMA.names)

    def employees(self) -> DataFrame:
        return (self.profile().withColumns({
            "salary": _money(F.col("salary_cents")),
            "email": F.concat(F.lower("employee_id"), F.lit("@example.com"))})
                .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EMPLOYEES_FILE]))

    def assignments(self) -> DataFrame:
        """A primary assignment for everyone, then numbered on, a second one for some."""
        people = self.profile()
        first = people.select(
            (F.col("i") + 1).alias("number"), "employee_id", "project",
            F.col("role").alias("assignment_role"), F.col("hire_date").alias("start_date"))
        chosen = people.where("second_project is not null").select(
            "i", "employee_id", F.col("second_project").alias("project"),
            F.lit("Cross-functional Member").alias("assignment_role"),
            F.col("hire_date").alias("start_date"))
        second = with_position(chosen, "number", ["i"], self.rows + 1).select(*first.columns)
        return first.unionByName(second).select(
            numbered("A", F.col("number"), 7).alias("assignment_id"), "employee_id",
            numbered("P", F.col("project"), 4).alias("project_id"),
            "assignment_role", "start_date", F.lit(None).cast("date").alias("end_date"),
        ).select(*ASSIGNMENTS.names)

    def _reviews_of(self, year: int, numbers_from: int) -> DataFrame:
        people = self.profile()
        if year == 2024:
            people = people.where(F.col("i") < self.with_past)
        else:
            people = people.where(F.year("hire_date") <= year)
        day = lambda text: F.lit(f"{year}-{text}").cast("date")
        # Reviews of the year with a past version fall inside that version.
        earliest = F.col("past_start") if year == 2024 else F.col("hire_date")
        low = F.least(F.greatest(earliest, day("01-15")), day("12-15"))
        department = _rotated(F.col("department_id")) if year == 2024 else F.col("department_id")
        typical = _choose(department, TYPICAL)
        score = (55 * F.col("base") + 35 * typical + 10 * F.col("role_effect")
                 + 100 * (REVIEW_YEARS[year] * POINT + normal(f"noise {year}", 7 * POINT)))
        score = clip(score, 35 * 100 * POINT, 99 * 100 * POINT)
        on_second = F.col("second_project").isNotNull() & (draw(f"on second {year}") % 100 < 25)
        return people.withColumn("_score", score).select(
            numbered("R", F.col("i") + numbers_from, 7).alias("review_id"), "employee_id",
            numbered("P", F.when(on_second, F.col("second_project")).otherwise(F.col("project")), 4)
            .alias("project_id"),
            _day_between(low, day("12-15"), f"review day {year}").alias("review_date"),
            # half to even, as the rating rule asks for
            clip(F.rint(F.col("_score") / F.lit(20.0 * 100 * POINT)).cast("int"), 1, 5).alias("rating"),
            (F.expr("(_score + 5000) div 10000").cast("decimal(6,0)") * F.lit(Decimal("0.01")))
            .cast(SCORE).alias("review_score"),
            F.lit(f"{year} performance review").alias("comments"),
        ).select(*REVIEWS.names)

    def reviews(self) -> DataFrame:
        """2024 for employees with a past, 2025 and 2026 for all hired by then."""
        out, numbers_from = None, 1
        for year in REVIEW_YEARS:
            part = self._reviews_of(year, numbers_from)
            out = part if out is None else out.unionByName(part)
            numbers_from += self.with_past if year == 2024 else self.rows
        return out

    def history(self) -> DataFrame:
        """An earlier department, role and salary for the first tenth of the employees."""
        names = _choose(F.col("past_department_id"), {d[0]: d[1] for d in DEPARTMENTS})
        cents = F.expr("(2 * salary_cents * pay_share + 10000) div 20000")
        return self.profile().where("past_start is not null").select(
            "employee_id", F.col("past_department_id").cast("int").alias("department_id"),
            names.alias("department_name"), F.col("past_role").alias("role"),
            _money(cents).alias("salary"), F.col("past_start").alias("start_date"),
            F.lit("2024-12-31").cast("date").alias("end_date"), F.lit(False).alias("is_current"),
        ).select(*EMPLOYEE_HISTORY.names)

    def tables(self) -> dict[str, DataFrame]:
        return {"departments": self.departments(), "employees": self.employees(),
                "projects": self.projects(), "assignments": self.assignments(),
                "reviews": self.reviews(), "employee_history": self.history()}


def keep_review_year(reviews: DataFrame, seed: int = 42) -> DataFrame:
    """Move reviews labelled ``<year> performance review`` into the year of their label."""
    label = F.regexp_extract("comments", r"^(\d{4}) performance review$", 1)
    year = F.when(matches(F.col("comments"), r"\d{4} performance review"), label.cast("int"))
    first = F.make_date(year, F.lit(1), F.lit(15))
    moved = F.date_add(first, between("guardrail", 0, 333).cast("int"))
    return (reviews.select("*", *words(seed, F.col("review_id")))
            .withColumn("review_date", F.when(F.year("review_date") != year, moved).otherwise(F.col("review_date")))
            .drop("w0", "w1"))
