"""The given tables read as workforce tables. Every mapping uses its whole source table.

Populations (employees with a past, with a second assignment, …) are told apart by values
such as the account balance, never by taking every n-th row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.functions.text import numbered
from staffmart.schemas import MONEY, SCORE

AS_OF = "2002-01-01"


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def employee_id(key: Column) -> Column:
    return numbered("E", key + 1, 6)


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).cast("int").alias("department_id"),
        F.col("n_name").alias("department_name"),
        F.col("r_name").alias("location"),
        ((F.col("n_nationkey") + 1) * 1000000).cast(MONEY).alias("budget"))


def _department_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation, sent to the tasks. Left to its guess of sizes, Spark takes the nations joined with the regions for
    larger than the customers, sends the customers, and one task makes all employees."""
    return F.broadcast(departments(spark, sf_dir).select("department_id", "department_name"))


def _hire_date() -> Column:
    return F.date_add(_date("1994-01-01"), F.pmod(F.col("c_custkey") * 37, F.lit(1095)).cast("int"))


def _salary() -> Column:
    return (F.lit(240000) + (F.col("c_acctbal").cast("decimal(15,2)") + 1000) * 30).cast(MONEY)


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        employee_id(k).alias("employee_id"),
        F.substring_index("c_name", "#", 1).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.concat(F.lower(employee_id(k)), F.lit("@example.com")).alias("email"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        (F.lit(21) + k % 45).cast("int").alias("age"),
        (F.col("c_nationkey") + 1).cast("int").alias("department_id"),
        F.col("c_mktsegment").alias("role"),
        _salary().alias("salary"),
        _hire_date().alias("hire_date"),
        F.when(F.col("c_acctbal") > 9400, "Resigned").otherwise("Active").alias("status"))
    return rows.join(_department_names(spark, sf_dir), "department_id")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    start = F.date_add(_date("1994-01-01"), ((k % 50) * 45).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("Planned", "Active", "Active", "Completed")]),
                          (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        numbered("P", k + 1, 4).alias("project_id"),
        F.concat(F.lit("Program "), (k % 5).cast("string")).alias("project_name"),
        F.col("s_name").alias("description"),
        start.alias("start_date"), F.date_add(start, 360).alias("end_date"), status.alias("status"))


def _project_of(index: Column) -> Column:
    """One of the first ten projects, uneven on purpose."""
    return numbered("P", (index + F.floor(index / 7)) % 10 + 1, 4)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    first = rows.select(
        numbered("A", k + 1, 7).alias("assignment_id"), employee_id(k).alias("employee_id"),
        _project_of(k * k).alias("project_id"), F.col("c_mktsegment").alias("assignment_role"),
        _hire_date().alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    second = rows.where("c_acctbal >= 6150").select(
        numbered("B", k + 1, 7).alias("assignment_id"), employee_id(k).alias("employee_id"),
        _project_of(k * k + 3).alias("project_id"),
        F.lit("Cross-functional Member").alias("assignment_role"),
        _hire_date().alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return first.unionByName(second)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        numbered("R", o + 1, 7).alias("review_id"),
        employee_id(F.col("o_custkey")).alias("employee_id"),
        _project_of(o * o).alias("project_id"),
        F.col("o_orderdate").cast("date").alias("review_date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        (F.floor(F.col("o_totalprice") / 50).cast("decimal(12,0)") / 100).cast(SCORE).alias("review_score"),
        F.concat((F.lit(1995) + o % 7).cast("string"), F.lit(" performance review")).alias("comments"))


def employee_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(
        employee_id(k).alias("employee_id"),
        ((F.col("c_nationkey") + 1) % 25 + 1).cast("int").alias("department_id"),
        F.col("c_mktsegment").alias("role"),
        (_salary() * F.lit(85) / 100).cast(MONEY).alias("salary"),
        F.date_add(_hire_date(), (F.lit(30) + k % 471).cast("int")).alias("start_date"),
        _date("1997-12-31").alias("end_date"),
        F.lit(False).alias("is_current"))
    return rows.join(_department_names(spark, sf_dir), "department_id")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"departments": departments(spark, sf_dir), "employees": employees(spark, sf_dir),
            "projects": projects(spark, sf_dir), "assignments": assignments(spark, sf_dir),
            "reviews": reviews(spark, sf_dir), "employee_history": employee_history(spark, sf_dir)}


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An earlier state of the same tables: fewer rows, older values."""
    now = tables(spark, sf_dir)
    early = now["employees"].where("hire_date < date'1996-01-01'")
    return {
        "departments": now["departments"].withColumns({
            "department_name": F.concat("department_name", F.lit(" (old)")), "budget": F.lit(1).cast(MONEY)}),
        "employees": early,
        "projects": now["projects"].where("start_date >= date'1994-03-01'").withColumns({
            "status": F.lit("Planned"), "end_date": F.lit(None).cast("date")}),
        "assignments": now["assignments"],
        "reviews": now["reviews"].where("review_date < date'2000-01-01'")
        .withColumn("rating", F.lit(3)),
        "employee_history": now["employee_history"].join(early, "employee_id", "left_semi"),
    }


def department_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as changes; department numbers 26 and 27 do not exist."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("change_id"),
        employee_id(F.col("user_id")).alias("employee_id"),
        (F.col("event_id") % 27 + 1).cast("int").alias("new_department_id"),
        F.col("ts").cast("date").alias("effective_date"))


def raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as badly kept versions: overlaps, reversed spans, missing current rows."""
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("employee_sk"),
        employee_id(F.col("user_id")).alias("employee_id"),
        day.alias("start_date"),
        F.date_add(day, (F.col("event_id") % 7 - 1).cast("int")).alias("end_date"),
        (F.col("event_id") % 9 == 0).alias("is_current"))


UNKNOWN_DEPARTMENT = 999


def twice(submissions: DataFrame, every: int) -> DataFrame:
    """The submissions, and every so many of them sent again."""
    return submissions.unionByName(submissions.where(F.col("submission_id") % every == 0))


def stored_keys(submissions: DataFrame, prefix: str, column: str, every: int) -> DataFrame:
    """Keys that were taken in earlier: those of every so many submissions."""
    key = F.concat(F.lit(f"{prefix}-"), F.col("submission_id").cast("string"))
    return submissions.where(F.col("submission_id") % every == 0).select(key.alias(column))


def nameless(submissions: DataFrame, which: Column) -> DataFrame:
    """Some submissions once more, without their id."""
    return submissions.where(which).withColumn("submission_id", F.lit(None).cast("long"))


def employee_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an onboarding form; k mod 15 names the rule the row breaks (0: none)."""
    k = F.col("c_custkey")
    slip = k % 15

    def field(good: Column, **bad: str) -> Column:
        out = F
        for number, value in bad.items():
            out = out.when(slip == int(number[1:]), value)
        return out.otherwise(good)

    return table(spark, sf_dir, "customer").select(
        k.alias("submission_id"),
        field(F.lit(" Customer "), n1="", n3="A1").alias("first_name"),
        field(F.col("c_mktsegment"), n2="  ", n4="B2").alias("last_name"),
        field(F.concat(F.lit("e"), k.cast("string"), F.lit("@example.com")), n5="no-at").alias("email"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        field((F.lit(21) + k % 45).cast("string"), n6="abc", n7="17", n8="71").alias("age"),
        F.when(k % 7 == 3, UNKNOWN_DEPARTMENT).otherwise(F.col("c_nationkey") + 1).cast("int").alias("department_id"),
        field(F.col("c_mktsegment"), n9="", n10="12345", n11="---").alias("role"),
        field(F.lit("500000"), n12="0", n14="abc").alias("salary"),
        F.when(slip == 13, _date("2100-01-01")).otherwise(_date("2001-01-01")).alias("hire_date"))


def shouted(submissions: DataFrame) -> DataFrame:
    """Forms of the first nations sent once more under another id, with their email in capitals."""
    again = submissions.where("department_id between 1 and 9")
    return submissions.unionByName(again.withColumns({
        "submission_id": F.col("submission_id") + 10**9, "email": F.upper("email")}))


def project_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("submission_id"),
        F.when(F.col("s_nationkey") == 3, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("project_name"),
        F.lit(" plan ").alias("description"),
        F.when(F.col("s_nationkey") == 4, F.lit(None).cast("date")).otherwise(_date("2001-01-01")).alias("start_date"),
        _date("2001-07-01").alias("end_date"), F.lit("Planned").alias("status"))


def assignment_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("submission_id"),
        F.when(F.col("c_nationkey") == 1, " ").when(F.col("c_nationkey") == 2, "X000001")
        .otherwise(F.concat(F.lit(" "), F.lower(employee_id(k)))).alias("employee_id"),
        F.when(F.col("c_nationkey") == 5, "P99999").otherwise(_project_of(k * k)).alias("project_id"),
        F.when(F.col("c_nationkey") == 6, "").otherwise(F.lit(" Team Member ")).alias("assignment_role"),
        _date("2001-01-01").alias("start_date"))


def review_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as review forms, with ratings 0 to 6 and scores up to 125."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("submission_id"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), employee_id(F.col("o_custkey"))))
        .otherwise(employee_id(F.col("o_custkey"))).alias("employee_id"),
        _project_of(o * o).alias("project_id"),
        F.col("o_orderdate").cast("date").alias("review_date"),
        (o % 7).cast("int").alias("rating"),
        (F.floor(F.col("o_totalprice") / 40).cast("decimal(12,0)") / 100).cast(SCORE).alias("review_score"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("comments"))


def reviews_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as text, columns turned round, with missing and bad ratings, scores and dates."""
    n = F.substring("review_id", 2, 20).cast("long")
    return reviews(spark, sf_dir).select(
        "comments", F.lit("left out").alias("source"),
        F.when(n % 7 == 0, "NaN").when(n % 7 == 1, "80 points").otherwise(F.col("review_score").cast("string")).alias("review_score"),
        F.when(n % 5 == 0, "nan").when(n % 5 == 1, "").otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(n % 11 == 0, "NaT").when(n % 11 == 1, "2001-02-30").otherwise(F.col("review_date").cast("string")).alias("review_date"),
        "project_id", "review_id", "employee_id")


def dirty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing values in all the spellings a file may hold."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("row_id"),
        F.when(o % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(o % 5 == 0, "NaN").when(o % 5 == 1, "").when(o % 5 == 2, "NaT")
        .otherwise(F.col("o_orderpriority")).alias("label"))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as seed rows, with unknown departments, blank roles and bad numbers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (k + 1001).cast("string").alias("EmployeeNumber"),
        F.when(k % 11 == 0, "n/a").otherwise((F.lit(15) + k % 60).cast("string")).alias("Age"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("Gender"),
        F.element_at(F.array(*[F.lit(d) for d in (
            "Engineering", "Finance", "Human Resources", "Sales", "Marketing", "Operations", "Legal",
            "Research")]), (k % 8 + 1).cast("int")).alias("Department"),
        F.when(k % 13 == 0, "nan").when(k % 13 == 1, "Data Scientist").when(k % 13 == 2, "Sales Executive")
        .when(k % 13 == 3, "Product Manager").otherwise(F.col("c_mktsegment")).alias("JobRole"),
        F.when(k % 17 == 0, "unknown").otherwise(F.floor(F.col("c_acctbal") * 10 + 20000).cast("string"))
        .alias("MonthlyIncome"),
        F.when(k % 19 == 0, "?").otherwise((k % 41).cast("string")).alias("YearsAtCompany"),
        (k % 5 + 1).cast("string").alias("JobLevel"),
        (k % 3 + 2).cast("string").alias("PerformanceRating"),
        F.when(k % 5 == 0, "Yes").otherwise("No").alias("Attrition"))
