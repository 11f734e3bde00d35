"""Department changes applied to the employee dimension in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.functions.dates import open_end
from staffmart.operators.lookup import join_found
from staffmart.operators.merge import next_key
from staffmart.operators.ordering import closed_up, number_chunks, sorted_chunks, with_next, with_previous

SAME_DAY, DAY_BEFORE = "same_day", "day_before"


@dataclass
class ScdResult:
    """dim_employee and employees after the changes; the changes that were refused."""

    dim_employee: DataFrame
    employees: DataFrame
    rejects: DataFrame


def _judge(changes: DataFrame, dim_employee: DataFrame, employees: DataFrame,
           dim_department: DataFrame, close_policy: str) -> DataFrame:
    """Changes with what they need from the tables, and ``reject_reason``."""
    newest = (dim_employee.where("is_current").groupBy("employee_id")
              .agg(F.max(F.struct("employee_sk", "department_sk", "start_date")).alias("now")))
    # Employees are looked up once per employee, not once per change; only one join sees
    # all changes of a busy employee.
    subjects = (changes.select("employee_id").distinct()
                .join(employees.select("employee_id", F.lit(True).alias("_known")), "employee_id", "left")
                .join(newest, "employee_id", "left")
                .select("employee_id", "_known", F.col("now.employee_sk").alias("_sk"),
                        F.col("now.department_sk").alias("_department_sk"),
                        F.col("now.start_date").alias("_start")))
    targets = dim_department.select(F.col("department_id").alias("new_department_id"),
                                    F.col("department_sk").alias("_target_sk"))
    too_early = F.col("effective_date") < F.col("_start")
    if close_policy == DAY_BEFORE:
        too_early = F.col("effective_date") <= F.col("_start")
    reason = (F.when(F.col("_known").isNull(), "unknown employee")
              .when(F.col("_target_sk").isNull(), "unknown department")
              .when(F.col("_sk").isNull(), "no current version")
              .when(F.col("effective_date").isNull(), "no effective date")
              .when(too_early, "effective before current start"))
    return (join_found(changes, subjects, "employee_id").join(targets, "new_department_id", "left")
            .withColumn("reject_reason", reason))


def _end_before(next_start: Column, close_policy: str) -> Column:
    return F.date_sub(next_start, 1) if close_policy == DAY_BEFORE else next_start


def apply_department_changes(dim_employee: DataFrame, changes: DataFrame, employees: DataFrame,
                             dim_department: DataFrame, close_policy: str = SAME_DAY, first_sk: int | None = None) -> ScdResult:
    """Apply (employee_id, new_department_id, effective_date, change_id) rows.

    Changes count in order of effective date, then change_id. A change to the department
    the employee is already in does nothing. Any other closes the version before it and
    opens one with the employee's current attributes. ``same_day`` ends the old version on
    the effective date itself, so several changes on a day leave versions of zero length;
    ``day_before`` ends it one day earlier and keeps the last change of a day only.

    Unknown employees and departments, employees without a current version and changes
    that take effect before the current version started are refused and change nothing. New versions are
    numbered from ``first_sk``, by default on from the highest key of ``dim_employee``.
    """
    judged = _judge(changes, dim_employee, employees, dim_department, close_policy)
    rejects = (judged.where("reject_reason is not null")
               .select("change_id", "employee_id", "new_department_id", "effective_date", "reject_reason"))
    valid = (judged.where("reject_reason is null")
             .select("employee_id", "effective_date", "change_id", "new_department_id",
                     "_target_sk", "_sk", "_department_sk"))
    ordered = sorted_chunks(valid, ["employee_id", "effective_date", "change_id"], "changes")
    if close_policy == DAY_BEFORE:
        ordered = (with_next(ordered, "employee_id", "effective_date", "_next_date")
                   .where("_next_date is null or _next_date <> effective_date").drop("_next_date"))

    moves = (with_previous(ordered, "employee_id", "_target_sk", "_before_sk")
             .withColumn("_before_sk", F.coalesce("_before_sk", "_department_sk"))
             .where("_before_sk <> _target_sk"))
    # Written once: the new versions, the closed ones and the employees all read it.
    moves = closed_up(with_next(moves, "employee_id", "effective_date", "_next_date"), "moves")
    opened = number_chunks(moves, "employee_sk", next_key(dim_employee, "employee_sk") if first_sk is None else first_sk)

    person = employees.select("employee_id", "first_name", "last_name", "email", "gender", "age",
                              "role", "salary", "hire_date")
    versions = (opened.join(person, "employee_id")
                .withColumn("department_sk", F.col("_target_sk"))
                .withColumn("start_date", F.col("effective_date"))
                .withColumn("end_date", F.coalesce(_end_before(F.col("_next_date"), close_policy), open_end()))
                .withColumn("is_current", F.col("_next_date").isNull())
                .select(*dim_employee.columns))

    closing = moves.groupBy("_sk").agg(F.min("effective_date").alias("_closed_by"))
    closed = (dim_employee.join(closing, F.col("employee_sk") == F.col("_sk"), "left")
              .withColumn("end_date", F.coalesce(_end_before(F.col("_closed_by"), close_policy),
                                                 F.col("end_date")))
              .withColumn("is_current", F.col("is_current") & F.col("_closed_by").isNull())
              .select(*dim_employee.columns))

    last_move = moves.where("_next_date is null").select(
        "employee_id", F.col("new_department_id").alias("_moved_to"))
    moved = employees.join(last_move, "employee_id", "left")
    if "updated_at" in employees.columns:
        moved = moved.withColumn("updated_at", F.when(F.col("_moved_to").isNotNull(), F.current_timestamp())
                                 .otherwise(F.col("updated_at")))
    moved = moved.withColumn("department_id", F.coalesce("_moved_to", "department_id")).select(*employees.columns)
    return ScdResult(closed.unionByName(versions), moved, rejects)
