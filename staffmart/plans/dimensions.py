"""Dimension tables: full build and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.functions.dates import calendar_columns, open_end
from staffmart.operators.merge import insert_missing, next_key
from staffmart.operators.ordering import with_position

VERSION_COLUMNS = [
    "employee_sk", "employee_id", "first_name", "last_name", "email", "gender", "age",
    "department_sk", "role", "salary", "hire_date", "start_date", "end_date", "is_current"]


class MissingReference(ValueError):
    """A row names a department or an employee that is not there."""


def build_dim_department(departments: DataFrame) -> DataFrame:
    rows = departments.select("department_id", "department_name", "location", "budget")
    return with_position(rows, "department_sk", ["department_id"])


def build_dim_project(projects: DataFrame) -> DataFrame:
    rows = projects.select("project_id", "project_name", "status", "start_date", "end_date")
    return with_position(rows, "project_sk", ["project_id"])


def build_dim_date(reviews: DataFrame) -> DataFrame:
    """Every day from the first to the last review, with or without reviews."""
    bounds = reviews.agg(F.min("review_date").alias("first"), F.max("review_date").alias("last"))
    days = bounds.where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day"))
    return days.select(*calendar_columns(F.col("day")))


def review_dates(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_date").where("review_date is not null").distinct()


def missing_dates(dim_date: DataFrame, reviews: DataFrame) -> DataFrame:
    """Calendar rows for review dates the dimension does not have yet."""
    observed = review_dates(reviews).select(*calendar_columns(F.col("review_date")))
    return insert_missing(dim_date, observed, "date_sk")


def extend_dim_date(dim_date: DataFrame, reviews: DataFrame) -> DataFrame:
    return dim_date.unionByName(missing_dates(dim_date, reviews))


def _with_department(rows: DataFrame, dim_department: DataFrame) -> DataFrame:
    keys = dim_department.select("department_id", "department_sk")
    return rows.join(keys, "department_id", "left")


def _require_references(rows: DataFrame) -> None:
    """Raise if a lookup found nothing; at most twenty of the offending values are shown."""
    message = F.when(F.col("department_sk").isNull(),
                     F.concat(F.lit("department not in the warehouse: "), F.col("department_id")))
    if "_known" in rows.columns:
        message = F.coalesce(F.when(F.col("_known").isNull(), F.concat(
            F.lit("history of unknown employee: "), F.col("employee_id"))), message)
    found = rows.select(message.alias("m")).where("m is not null").distinct().limit(20).collect()
    if found:
        raise MissingReference("; ".join(sorted(r.m for r in found)))


def employee_versions(employees: DataFrame, history: DataFrame, dim_department: DataFrame,
                      current_start=None) -> DataFrame:
    """Past and current versions without their keys; unmatched lookups stay NULL.

    A past version stores what changed and takes the rest from the employee. A current
    version starts on the hire date, or for employees with a past on ``current_start``
    (default: the day after the last past version of anyone ends).
    """
    person = employees.select("employee_id", "first_name", "last_name", "email", "gender", "age",
                              "hire_date", F.lit(True).alias("_known"))
    past = (history.select("employee_id", "department_id", "role", "salary", "start_date", "end_date")
            .join(person, "employee_id", "left")
            .withColumn("is_current", F.lit(False)))
    if current_start is None:
        current_start = history.agg(F.date_add(F.max("end_date"), 1)).first()[0]
    with_past = history.select("employee_id", F.lit(True).alias("_past")).distinct()
    now = (employees
           .select("employee_id", "first_name", "last_name", "email", "gender", "age",
                   "department_id", "role", "salary", "hire_date", F.lit(True).alias("_known"))
           .join(with_past, "employee_id", "left")
           .withColumn("start_date", F.when(F.col("_past"), F.lit(current_start).cast("date"))
                       .otherwise(F.col("hire_date")))
           .withColumn("end_date", open_end())
           .withColumn("is_current", F.lit(True))
           .drop("_past"))
    return _with_department(past.unionByName(now), dim_department)


def build_dim_employee(employees: DataFrame, history: DataFrame, dim_department: DataFrame,
                       current_start=None) -> DataFrame:
    """Type 2 dimension: past versions are numbered first, then current ones, by employee."""
    versions = employee_versions(employees, history, dim_department, current_start)
    numbered = with_position(versions, "employee_sk", ["is_current", "employee_id", "start_date"])
    # The numbered rows are a written table, so this check does not repeat the joins.
    _require_references(numbered)
    return numbered.select(*VERSION_COLUMNS)


def new_employees(dim_employee: DataFrame, employees: DataFrame) -> DataFrame:
    """Employees without any version in the dimension."""
    return employees.join(dim_employee, "employee_id", "left_anti")


def first_versions(dim_employee: DataFrame, employees: DataFrame, dim_department: DataFrame) -> DataFrame:
    """First version of each new employee, valid from the hire date."""
    rows = (_with_department(new_employees(dim_employee, employees), dim_department)
            .withColumn("start_date", F.col("hire_date"))
            .withColumn("end_date", open_end())
            .withColumn("is_current", F.lit(True)))
    numbered = with_position(rows, "employee_sk", ["employee_id"], next_key(dim_employee, "employee_sk"))
    _require_references(numbered)
    return numbered.select(*VERSION_COLUMNS)


def append_new_employees(dim_employee: DataFrame, employees: DataFrame,
                         dim_department: DataFrame) -> DataFrame:
    """Known employees are left as they are, whatever their row says now."""
    return dim_employee.unionByName(first_versions(dim_employee, employees, dim_department))
