"""Schemas of the interchange files, the operational tables and the star schema."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
SCORE = T.DecimalType(6, 2)


def _schema(*fields: tuple) -> T.StructType:
    """Fields are (name, type) or (name, type, "null"); the rest are NOT NULL by contract."""
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2) for f in fields])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.BooleanType()

DEPARTMENTS = _schema(
    ("department_id", I), ("department_name", S), ("location", S), ("budget", MONEY))

# Interchange and staging form; the operational table has no department_name.
EMPLOYEES_FILE = _schema(
    ("employee_id", S), ("first_name", S), ("last_name", S), ("email", S),
    ("gender", S, "null"), ("age", I, "null"), ("department_id", I), ("department_name", S),
    ("role", S), ("salary", MONEY), ("hire_date", D), ("status", S))

EMPLOYEES = T.StructType([f for f in EMPLOYEES_FILE if f.name != "department_name"])

PROJECTS = _schema(
    ("project_id", S), ("project_name", S), ("description", S, "null"),
    ("start_date", D), ("end_date", D, "null"), ("status", S))

ASSIGNMENTS = _schema(
    ("assignment_id", S), ("employee_id", S), ("project_id", S), ("assignment_role", S),
    ("start_date", D), ("end_date", D, "null"))

REVIEWS = _schema(
    ("review_id", S), ("employee_id", S), ("project_id", S), ("review_date", D),
    ("rating", I), ("review_score", SCORE), ("comments", S, "null"))

EMPLOYEE_HISTORY = _schema(
    ("employee_id", S), ("department_id", I), ("department_name", S), ("role", S),
    ("salary", MONEY), ("start_date", D), ("end_date", D), ("is_current", B))

# All seed columns arrive as text: the generator parses them leniently.
SEED = T.StructType([T.StructField(name, S) for name in (
    "EmployeeNumber", "Age", "Gender", "Department", "JobRole", "MonthlyIncome",
    "YearsAtCompany", "JobLevel", "PerformanceRating", "Attrition")])

DIM_DEPARTMENT = _schema(
    ("department_sk", L), ("department_id", I), ("department_name", S),
    ("location", S, "null"), ("budget", MONEY, "null"))

DIM_PROJECT = _schema(
    ("project_sk", L), ("project_id", S), ("project_name", S), ("status", S, "null"),
    ("start_date", D, "null"), ("end_date", D, "null"))

DIM_DATE = _schema(
    ("date_sk", I), ("full_date", D), ("day_of_month", I), ("month_num", I),
    ("month_name", S), ("quarter_num", I), ("year_num", I))

DIM_EMPLOYEE = _schema(
    ("employee_sk", L), ("employee_id", S), ("first_name", S), ("last_name", S),
    ("email", S, "null"), ("gender", S, "null"), ("age", I, "null"), ("department_sk", L),
    ("role", S), ("salary", MONEY), ("hire_date", D), ("start_date", D), ("end_date", D),
    ("is_current", B))

# year_num is the partition column of the stored table.
FACT = _schema(
    ("review_sk", L), ("review_id", S), ("employee_sk", L), ("project_sk", L),
    ("department_sk", L), ("date_sk", I), ("rating", I), ("review_score", SCORE),
    ("review_count", I), ("year_num", I))

# Set by the job that writes employees.
AUDIT_TIMES = _schema(("created_at", T.TimestampType()), ("updated_at", T.TimestampType()))

FILES = {
    "departments": DEPARTMENTS, "employees": EMPLOYEES_FILE, "projects": PROJECTS,
    "assignments": ASSIGNMENTS, "reviews": REVIEWS, "employee_history": EMPLOYEE_HISTORY,
}

OPERATIONAL = {
    "departments": DEPARTMENTS, "employees": EMPLOYEES, "projects": PROJECTS,
    "assignments": ASSIGNMENTS, "reviews": REVIEWS,
}

STAR = {
    "dim_department": DIM_DEPARTMENT, "dim_project": DIM_PROJECT, "dim_date": DIM_DATE,
    "dim_employee": DIM_EMPLOYEE, "fact": FACT,
}

# Widths of the text columns.
TEXT_LIMITS = {
    "employee_id": 20, "first_name": 80, "last_name": 80, "email": 160, "gender": 20,
    "department_name": 100, "role": 120, "status": 30, "location": 100, "project_id": 20,
    "project_name": 160, "description": 500, "assignment_id": 30, "assignment_role": 120,
    "review_id": 30, "comments": 1000,
}

# Keys that must be unique, and references (child, column, parent).
OPERATIONAL_KEYS = [
    ("departments", "department_id"), ("departments", "department_name"), ("employees", "employee_id"),
    ("employees", "email"), ("projects", "project_id"), ("assignments", "assignment_id"), ("reviews", "review_id"),
]
# Unique text that is to be compared without case and accents, where a database does so, and how.
INSENSITIVE = {("departments", "department_name"), ("employees", "email")}
COLLATION = "UNICODE_CI_AI_RTRIM"


def collated(table: str, schema: T.StructType) -> T.StructType:
    """The schema with collated strings for the columns of ``INSENSITIVE``: they group, join and compare that way."""
    return T.StructType([T.StructField(f.name, T.StringType(COLLATION), f.nullable) if (table, f.name) in INSENSITIVE else f
                         for f in schema])


OPERATIONAL_REFERENCES = [
    ("employees", "department_id", "departments"), ("assignments", "employee_id", "employees"),
    ("assignments", "project_id", "projects"), ("reviews", "employee_id", "employees"),
    ("reviews", "project_id", "projects"),
]
STAR_KEYS = [
    ("dim_department", "department_id"), ("dim_project", "project_id"), ("dim_date", "date_sk"),
    ("dim_date", "full_date"), ("dim_employee", "employee_sk"), ("fact", "review_sk"), ("fact", "review_id"),
]
STAR_REFERENCES = [
    ("dim_employee", "department_sk", "dim_department"), ("fact", "employee_sk", "dim_employee"),
    ("fact", "project_sk", "dim_project"), ("fact", "department_sk", "dim_department"), ("fact", "date_sk", "dim_date"),
]
