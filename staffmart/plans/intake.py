"""Submitted rows become operational rows, or go to quarantine with a reason.

A row's key is the prefix of its table, a dash and its submission id, so two submissions never
share a key, a repeated job gives the same one, and it differs from the keys of loaded rows, which have no
dash. Ids of more than 18 digits are refused: their keys would not fit 20 characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.functions.numbers import parse_float
from staffmart.functions.text import insensitive, strip
from staffmart.operators.lookup import join_found
from staffmart.operators.validate import (
    FORM, validate_assignments, validate_employees, validate_projects, validate_reviews)
from staffmart.schemas import ASSIGNMENTS, EMPLOYEES, MONEY, PROJECTS, REVIEWS

DEFAULT_STATUS = "Active"  # fixed value
ID_DIGITS = 18


@dataclass
class Intake:
    """accepted: rows to append to the table; quarantine: submitted rows with reject_reason."""

    accepted: DataFrame
    quarantine: DataFrame


def _quarantine(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason is not null")


def _key(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.col("submission_id").cast("string"))


def once(intake: DataFrame) -> DataFrame:
    """One row per submission id: of rows sent again under it, the smallest in the order of the columns.

    Found by an aggregate with map-side combine, so one id repeated in many rows stays cheap.
    Rows without an id are kept; they are refused later.
    """
    others = [c for c in intake.columns if c != "submission_id"]
    named = (intake.where("submission_id is not null").groupBy("submission_id")
             .agg(F.min(F.struct(*others)).alias("_row")).select("submission_id", "_row.*"))
    return named.select(*intake.columns).unionByName(intake.where("submission_id is null"))


def _refuse(judged: DataFrame, wrong: Column, reason: str) -> DataFrame:
    return judged.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & wrong, reason)
                             .otherwise(F.col("reject_reason")))


def _refuse_known(judged: DataFrame, stored: DataFrame | None, column: str, prefix: str) -> DataFrame:
    """Refuse rows without a submission id and those whose key is stored already."""
    judged = _refuse(judged, F.col("submission_id").isNull(), "submission id required")
    judged = _refuse(judged, F.length(F.col("submission_id").cast("string")) > ID_DIGITS, "submission id too long")
    if stored is None or column not in stored.columns:
        return judged
    known = stored.select(F.col(column).alias("_key"), F.lit(True).alias("_taken")).distinct()
    judged = join_found(judged.withColumn("_key", _key(prefix)), known, "_key")
    return _refuse(judged, F.col("_taken").isNotNull(), "already taken in").drop("_key", "_taken")


def _refuse_taken(judged: DataFrame, stored: DataFrame | None, column: str, value: Column,
                  reason: str) -> DataFrame:
    """Refuse rows whose unique value is stored already or was submitted earlier.

    The earliest submission is found by an aggregate with map-side combine, so one value
    repeated in a third of the rows stays cheap.
    """
    judged = judged.withColumn("_value", F.when(F.col("reject_reason").isNull(), value))
    first = (judged.where("_value is not null").groupBy("_value")
             .agg(F.min("submission_id").alias("_first")))
    taken = F.col("_first") != F.col("submission_id")
    if stored is not None:
        kind = judged.schema["_value"].dataType
        known = stored.select(F.col(column).cast(kind).alias("_value"), F.lit(True).alias("_stored")).distinct()
        first = first.join(known, "_value", "left")
        taken = taken | F.col("_stored").isNotNull()
    return _refuse(join_found(judged, first, "_value"), taken, reason).drop("_value", "_first", "_stored")


def intake_employees(intake: DataFrame, stored: DataFrame | None = None, as_of=None,
                     rules: str = FORM, departments: DataFrame | None = None, collation: bool = False) -> Intake:
    """Onboarding rows: submission_id, form text columns, gender, department_id, hire_date.

    With ``departments`` a row must name one of them. With ``collation`` emails are one if they differ in
    case and accents only.
    """
    judged = validate_employees(once(intake), as_of, rules)
    if departments is not None:
        known = departments.select("department_id", F.lit(True).alias("_known")).distinct()
        judged = join_found(judged, known, "department_id")
        judged = _refuse(judged, F.col("_known").isNull(), "unknown department").drop("_known")
    judged = _refuse_known(judged, stored, "employee_id", "E")
    email = strip(F.col("email"))
    judged = _refuse_taken(judged, stored, "email", insensitive(email) if collation else email, "email already used")
    good = judged.where("reject_reason is null")
    accepted = good.select(
        _key("E").alias("employee_id"),
        strip(F.col("first_name")).alias("first_name"),
        strip(F.col("last_name")).alias("last_name"),
        strip(F.col("email")).alias("email"),
        "gender",
        strip(F.col("age").cast("string")).cast("int").alias("age"),
        "department_id",
        strip(F.col("role")).alias("role"),
        parse_float(F.col("salary").cast("string")).cast(MONEY).alias("salary"),
        "hire_date",
        (F.coalesce(F.col("status"), F.lit(DEFAULT_STATUS)) if "status" in intake.columns
         else F.lit(DEFAULT_STATUS)).alias("status"))
    return Intake(accepted.select(*EMPLOYEES.names), _quarantine(judged))


def with_audit_times(rows: DataFrame) -> DataFrame:
    """created_at and updated_at, set by the job that writes the rows."""
    return rows.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def intake_projects(intake: DataFrame, stored: DataFrame | None = None) -> Intake:
    judged = _refuse_known(validate_projects(once(intake)), stored, "project_id", "P")
    accepted = judged.where("reject_reason is null").select(
        _key("P").alias("project_id"),
        strip(F.col("project_name")).alias("project_name"),
        strip(F.col("description")).alias("description"),
        "start_date", "end_date", "status")
    return Intake(accepted.select(*PROJECTS.names), _quarantine(judged))


def intake_assignments(intake: DataFrame, employees: DataFrame, projects: DataFrame,
                       stored: DataFrame | None = None) -> Intake:
    judged = _refuse_known(validate_assignments(once(intake), employees, projects), stored, "assignment_id", "A")
    accepted = judged.where("reject_reason is null").select(
        _key("A").alias("assignment_id"),
        F.upper(strip(F.col("employee_id"))).alias("employee_id"),
        "project_id", strip(F.col("assignment_role")).alias("assignment_role"),
        "start_date", F.lit(None).cast("date").alias("end_date"))
    return Intake(accepted.select(*ASSIGNMENTS.names), _quarantine(judged))


def intake_reviews(intake: DataFrame, employees: DataFrame, projects: DataFrame,
                   stored: DataFrame | None = None) -> Intake:
    judged = _refuse_known(validate_reviews(once(intake), employees, projects), stored, "review_id", "R")
    accepted = judged.where("reject_reason is null").select(
        _key("R").alias("review_id"),
        F.upper(strip(F.col("employee_id"))).alias("employee_id"),
        "project_id", "review_date", "rating", "review_score",
        strip(F.col("comments")).alias("comments"))
    return Intake(accepted.select(*REVIEWS.names), _quarantine(judged))
