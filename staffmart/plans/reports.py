"""Reports on the operational tables and on the star schema.

Measures are summed by surrogate key before any join, so a project, department or employee
with a third of all reviews is reduced on the map side and the joins see one row per key. A warehouse that keeps its
sums by year (``staffmart.plans.sums``) answers from them and does not read its facts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffmart.functions.dates import as_of_date, completed_years
from staffmart.functions.text import full_name
from staffmart.operators.ordering import rows_in_tiles, tile_of, with_tile_of_levels
from staffmart.plans.sums import people_per_project
from staffmart.plans.warehouse import Warehouse
from staffmart.sources.tables import materialise

# Risk tiles and levels, and the score given to employees without reviews.
RISK_TILES = 20
HIGH_TILES, MEDIUM_TILES = 4, 15
RISK_LEVELS = ["High", "Medium", "Low"]
DEFAULT_SCORE = 70
PERFORMANCE_WEIGHT = Decimal("0.60")


def _name() -> Column:
    return full_name(F.col("first_name"), F.col("last_name")).alias("employee_name")


def _partial_sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("review_score").alias("_total"), F.count(F.lit(1)).alias("_n"))


def _by_department(w: Warehouse) -> DataFrame:
    return _partial_sums(w.fact, "department_sk") if w.sums is None else _again(w.sums.by_department, "department_sk")


def _by_employee(w: Warehouse) -> DataFrame:
    keys = ["employee_sk", "department_sk"]
    return _partial_sums(w.fact, *keys) if w.sums is None else _again(w.sums.by_employee, *keys)


def _again(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("_total").alias("_total"), F.sum("_n").alias("_n"))


def _mean() -> Column:
    """Mean of the summed scores with six decimals, as AVG of the scores gives it."""
    quotient = F.col("_total").cast("decimal(20,2)") / F.col("_n").cast("decimal(12,0)")
    return quotient.cast("decimal(10,6)")


def _mean2() -> Column:
    return F.round(_mean(), 2)


# --- operational tables ---------------------------------------------------------------

def employee_directory(employees: DataFrame, departments: DataFrame, limit: int = 100) -> DataFrame:
    return (employees.join(departments.select("department_id", "department_name"), "department_id")
            .select("employee_id", _name(), "department_name", "role", "salary", "status")
            .orderBy("employee_id").limit(limit))


def employee_lookup(spark: SparkSession, employees: DataFrame, employee_id: str) -> DataFrame:
    return spark.sql("SELECT * FROM {employees} WHERE employee_id = :id",
                     args={"id": employee_id}, employees=employees)


def employee_exists(ids: DataFrame, employees: DataFrame) -> DataFrame:
    """Each asked-for employee_id once, with a flag."""
    known = employees.select("employee_id", F.lit(True).alias("_known"))
    return (ids.select("employee_id").distinct().join(known, "employee_id", "left")
            .select("employee_id", F.col("_known").isNotNull().alias("employee_exists")))


def department_list(departments: DataFrame) -> DataFrame:
    return departments.select("department_id", "department_name").orderBy("department_name", "department_id")


def project_list(projects: DataFrame) -> DataFrame:
    return (projects.select("project_id", "project_name", "status", "start_date", "end_date")
            .orderBy("project_name", "project_id"))


# --- star schema ----------------------------------------------------------------------

def kpis(w: Warehouse) -> DataFrame:
    """One row: employees with a current version, reviews, mean and total score."""
    if w.sums is not None:
        return w.fact.sparkSession.sql("""
            SELECT (SELECT count(DISTINCT employee_id) FROM {versions} WHERE is_current) AS employees,
                   coalesce(sum(_n), 0) AS reviews,
                   round(cast(cast(sum(_total) AS decimal(20,2)) / cast(sum(_n) AS decimal(12,0)) AS decimal(10,6)), 2) AS avg_score,
                   round(sum(_total), 2) AS total_score
            FROM {sums}""", versions=w.dim_employee, sums=w.sums.by_department)
    return w.fact.sparkSession.sql("""
        SELECT (SELECT count(DISTINCT employee_id) FROM {versions} WHERE is_current) AS employees,
               count(*) AS reviews,
               round(avg(review_score), 2) AS avg_score,
               round(sum(review_score), 2) AS total_score
        FROM {fact}""", versions=w.dim_employee, fact=w.fact)


def yearly_trend(w: Warehouse) -> DataFrame:
    if w.sums is not None:
        by_year = _again(w.sums.by_department, "year_num")
    else:
        by_year = _again(_partial_sums(w.fact, "date_sk").join(w.dim_date, "date_sk"), "year_num")
    return by_year.select(F.col("year_num").alias("year"), _mean2().alias("avg_score")).orderBy("year")


def _top(scores: DataFrame, group: str, k: int) -> DataFrame:
    """Rows with one of the k best scores of their group, ties kept, and their dense rank.

    Ranking the distinct scores and joining back keeps employees tied on one score in as
    many tasks as they come in.
    """
    best = (scores.select(group, "avg_score").distinct()
            .withColumn("performance_rank",
                        F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("avg_score"))))
            .where(F.col("performance_rank") <= k))
    return scores.join(best, [group, "avg_score"])


def top_employees(w: Warehouse, k: int = 3) -> DataFrame:
    """Best k mean scores per department name, over all versions of an employee."""
    person = w.dim_employee.select("employee_sk", "employee_id", "first_name", "last_name")
    names = w.dim_department.select("department_sk", "department_name")
    scores = _again(
        _by_employee(w)
        .join(person, "employee_sk").join(names, "department_sk"),
        "department_name", "employee_id", "first_name", "last_name")
    scores = scores.select("department_name", "employee_id", _name(), _mean().alias("avg_score"))
    return (_top(scores, "department_name", k)
            .select("department_name", "employee_id", "employee_name", "avg_score", "performance_rank")
            .orderBy("department_name", "performance_rank", "employee_name", "employee_id"))


def top_employees_by_sk(w: Warehouse, k: int = 3) -> DataFrame:
    """As top_employees, grouped and ranked by the department key of the version."""
    person = w.dim_employee.select("employee_sk", F.col("department_sk").alias("version_department_sk"),
                                   "employee_id", "first_name", "last_name")
    names = w.dim_department.select("department_sk", "department_name")
    scores = _again(
        _by_employee(w)
        .join(person, "employee_sk").join(names, "department_sk"),
        "version_department_sk", "department_name", "employee_id", "first_name", "last_name")
    scores = scores.select(F.col("version_department_sk").alias("department_sk"), "department_name",
                           "employee_id", _name(), _mean().alias("avg_score"))
    return (_top(scores, "department_sk", k)
            .select("department_sk", "department_name", "employee_id", "employee_name", "avg_score",
                    "performance_rank")
            .orderBy("department_name", "performance_rank", "employee_id"))


def project_bottlenecks(w: Warehouse, by: str = "employee_sk") -> DataFrame:
    """Workload per project name. ``by="employee_id"`` counts people instead of versions."""
    if w.sums is not None and by == "employee_sk":
        names = w.dim_project.select("project_sk", "project_name")
        people = people_per_project(w.sums.people_by_project.join(names, "project_sk"), "project_name")
        sums = _again(w.sums.by_project.join(names, "project_sk"), "project_name")
        return (sums.join(people, "project_name")
                .select("project_name", F.col("people").alias("employee_count"), F.col("_n").alias("review_count"), _mean2().alias("avg_score"))
                .orderBy(F.desc("employee_count"), F.desc("review_count"), "project_name"))
    pairs = _partial_sums(w.fact, "project_sk", "employee_sk")
    if by != "employee_sk":
        pairs = pairs.join(w.dim_employee.select("employee_sk", by), "employee_sk")
    pairs = pairs.join(w.dim_project.select("project_sk", "project_name"), "project_sk")
    # One row per project and employee first: the distinct count of a hot project is then
    # an ordinary count with map-side combine.
    once = _again(pairs, "project_name", by)
    return (once.groupBy("project_name")
            .agg(F.count(F.lit(1)).alias("employee_count"), F.sum("_total").alias("_total"),
                 F.sum("_n").alias("_n"))
            .select("project_name", "employee_count", F.col("_n").alias("review_count"),
                    _mean2().alias("avg_score"))
            .orderBy(F.desc("employee_count"), F.desc("review_count"), "project_name"))


def project_bottlenecks_by_id(w: Warehouse) -> DataFrame:
    if w.sums is not None:
        people = people_per_project(w.sums.people_by_project, "project_sk")
        by_key = _again(w.sums.by_project, "project_sk").join(people, "project_sk").withColumnRenamed("people", "employees_reviewed")
    else:
        by_key = (w.fact.groupBy("project_sk")
                  .agg(F.countDistinct("employee_sk").alias("employees_reviewed"),
                       F.sum("review_score").alias("_total"), F.count(F.lit(1)).alias("_n")))
    return (by_key.join(w.dim_project.select("project_sk", "project_id", "project_name"), "project_sk")
            .select("project_id", "project_name", "employees_reviewed",
                    F.col("_n").alias("review_count"), _mean2().alias("avg_score"))
            .orderBy(F.desc("employees_reviewed"), F.desc("review_count"), "project_id"))


def department_performance(w: Warehouse) -> DataFrame:
    names = w.dim_department.select("department_sk", "department_name")
    by_name = _again(_by_department(w).join(names, "department_sk"), "department_name")
    return (by_name.select("department_name", F.col("_n").alias("review_count"),
                           _mean2().alias("avg_score"))
            .orderBy(F.desc("avg_score"), "department_name"))


def risk_scores(w: Warehouse, as_of=None) -> DataFrame:
    """Rule-based score per current version; reviews of earlier versions do not count."""
    if w.sums is not None:
        means = _again(w.sums.by_employee, "employee_sk").select("employee_sk", _mean().alias("avg_score"))
    else:
        means = w.fact.groupBy("employee_sk").agg(F.avg("review_score").alias("avg_score"))
    people = w.dim_employee.where("is_current").select(
        "employee_sk", "employee_id", _name(), "salary",
        completed_years(F.col("hire_date"), as_of_date(as_of)).alias("years_at_company"))
    score = F.coalesce(F.col("avg_score"), F.lit(DEFAULT_SCORE).cast("decimal(10,6)"))
    performance = F.greatest(F.lit(0), (100 - score) * F.lit(PERFORMANCE_WEIGHT))
    years, salary = F.col("years_at_company"), F.col("salary")
    # fixed values: points by years at the company and by pay
    tenure = (F.when(years.between(2, 5), 10).when(years < 2, 8).when(years.between(6, 10), 5)
              .otherwise(2))
    pay = F.when(salary < 300000, 15).when(salary < 400000, 10).when(salary < 500000, 5).otherwise(0)
    total = F.least(F.lit(100), F.greatest(F.lit(0), performance + tenure + pay))
    return (people.join(means, "employee_sk", "left")
            .select("employee_id", "employee_name", "years_at_company", "avg_score", "salary",
                    F.round(total, 2).alias("risk_score")))


def _level(tile: Column) -> Column:
    return (F.when(tile <= HIGH_TILES, RISK_LEVELS[0]).when(tile <= MEDIUM_TILES, RISK_LEVELS[1])
            .otherwise(RISK_LEVELS[2]).alias("risk_level"))


def _listed(scores: DataFrame, tile: str) -> DataFrame:
    return scores.select("employee_id", "employee_name", "years_at_company", F.round("avg_score", 2).alias("avg_score"),
                         "salary", "risk_score", _level(F.col(tile)))


def attrition_risk(w: Warehouse, as_of=None) -> DataFrame:
    """Risk level by rank among all current employees: 20 % high, 55 % medium, 25 % low."""
    # Scores from 0 to 100 with two decimals: ten thousand levels at most, whatever the number of employees.
    tiled = with_tile_of_levels(materialise(risk_scores(w, as_of), "risk"), "risk_group", RISK_TILES, "risk_score", "employee_id")
    return _listed(tiled, "risk_group").orderBy(F.desc("risk_score"), "employee_name", "employee_id")


def attrition_distribution(w: Warehouse, as_of=None) -> DataFrame:
    """Employees per level; a level nobody has is listed with 0.

    Levels are shares of the ranking, so their sizes follow from the number of current employees alone.
    """
    bounds = [(1, HIGH_TILES), (HIGH_TILES + 1, MEDIUM_TILES), (MEDIUM_TILES + 1, RISK_TILES)]
    people = w.dim_employee.where("is_current").agg(F.count(F.lit(1)).alias("_n"))
    sizes = [F.struct(F.lit(level).alias("risk_level"), rows_in_tiles(F.col("_n"), RISK_TILES, *bound).alias("employee_count"))
             for level, bound in zip(RISK_LEVELS, bounds)]
    return people.select(F.inline(F.array(*sizes)))


def attrition_top(w: Warehouse, as_of=None, n: int = 15) -> DataFrame:
    """The first ``n`` of ``attrition_risk`` without ranking everyone.

    Whoever has a higher score than one of them is one of them too, so the place of each in the
    ranking is its rank among the ``n``, plus those anywhere with the same score and a smaller id.
    """
    scores = risk_scores(w, as_of)
    order = [F.desc("risk_score"), "employee_name", "employee_id"]
    top = materialise(scores.orderBy(*order).limit(n), "top")
    rivals = F.broadcast(top.select("risk_score", F.col("employee_id").alias("_id")))  # n rows
    ahead = (scores.select("risk_score", "employee_id").join(rivals, "risk_score").where(F.col("employee_id") < F.col("_id"))
             .groupBy("_id").agg(F.count(F.lit(1)).alias("_ahead")))
    higher = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("risk_score")))  # over n rows
    placed = top.withColumn("_higher", higher).join(ahead, F.col("employee_id") == F.col("_id"), "left")
    people = w.dim_employee.where("is_current").count()
    placed = placed.withColumn("risk_group", tile_of(F.col("_higher") + F.coalesce("_ahead", F.lit(0)), people, RISK_TILES))
    return _listed(placed, "risk_group").orderBy(*order)
