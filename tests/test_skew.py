"""Jobs whose joins meet one key in most of the rows are split by adaptive execution."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from staffmart.operators.scd2 import _judge
from staffmart.operators.validate import validate_reviews
from staffmart.plans.dimensions import build_dim_department
from staffmart.plans.intake import _refuse_taken
from staffmart.plans.reports import project_bottlenecks
from staffmart.plans.warehouse import Warehouse


@pytest.fixture(autouse=True)
def small_splits(spark):
    """No broadcasts, and a split threshold that test data can reach."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def split_joins(df):
    df.collect()
    return len(re.findall(r"SortMergeJoin\(skew=true\)", df._jdf.queryExecution().executedPlan().toString()))


def hot(spark, n=20000):
    return spark.range(n).withColumn(
        "employee_id", F.when(F.col("id") % 3 > 0, "E0").otherwise(F.concat(F.lit("E"), F.col("id") % 40)))


def test_reviews_of_a_hot_employee(spark, make):
    rows = hot(spark).select(
        F.col("id").alias("submission_id"), "employee_id", F.concat(F.lit("P"), F.col("id") % 50).alias("project_id"),
        F.current_date().alias("review_date"), F.lit(3).alias("rating"), F.lit(50).alias("review_score"))
    people = make.employees(*[dict(employee_id=f"E{i}") for i in range(40)])
    projects = rows.select("project_id").distinct()
    judged = validate_reviews(rows, people, projects)
    assert judged.where("reject_reason is null").count() == 20000
    assert split_joins(judged) >= 1


def test_changes_of_a_hot_employee(spark, make):
    people = [dict(employee_id=f"E{i}") for i in range(40)]
    changes = hot(spark).select("employee_id", F.lit(1).alias("new_department_id"),
                                F.current_date().alias("effective_date"), F.col("id").alias("change_id"))
    judged = _judge(changes, make.versions(*people), make.employees(*people),
                    build_dim_department(make.departments("A")), "same_day")
    assert judged.where("reject_reason is null").count() == 20000
    assert split_joins(judged) >= 1


def test_one_email_in_most_submissions(spark):
    rows = hot(spark).select(F.col("id").alias("submission_id"), F.col("employee_id").alias("email"),
                             F.lit(None).cast("string").alias("reject_reason"))
    judged = _refuse_taken(rows, None, "email", F.col("email"), "taken")
    assert judged.where("reject_reason is null").count() == 40
    assert split_joins(judged) >= 1


def test_reports_on_a_hot_project(spark):
    """The fact rows of a project are reduced before they are joined or counted."""
    fact = hot(spark).select((F.col("id") % 500).alias("employee_sk"),
                             F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40).alias("project_sk"),
                             F.lit(50).cast("decimal(6,2)").alias("review_score"))
    projects = spark.range(40).select(F.col("id").alias("project_sk"), F.concat(F.lit("P"), "id").alias("project_name"))
    report = project_bottlenecks(Warehouse(None, projects, None, None, fact))
    first = report.first()
    assert (first.project_name, first.employee_count) == ("P0", 500)
    assert report.agg(F.sum("review_count")).first()[0] == 20000
