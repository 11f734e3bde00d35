"""Value rules for submitted rows. The first broken rule is the reason for the refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.functions.dates import as_of_date
from staffmart.functions.numbers import INTEGER, parse_float
from staffmart.functions.text import is_blank, matches, strip
from staffmart.operators.lookup import join_found, known_keys

# Accepted forms and ranges.
NAME = r"[A-Za-z][A-Za-z\s'-]*"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
AGE_RANGE = (18, 70)
RATING_RANGE = (1, 5)
SCORE_RANGE = (0, 100)

FORM, WRITE = "form", "write"


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds, else NULL."""
    chain = None
    for name, broken in rules:
        broken = F.coalesce(broken, F.lit(False))
        chain = F.when(broken, name) if chain is None else chain.when(broken, name)
    return chain


def _age_rules(age: Column) -> list[tuple[str, Column]]:
    number = strip(age).try_cast("decimal(38,0)")  # whole range of integers anyone can type
    return [("age not an integer", ~matches(strip(age), INTEGER)),
            ("age out of range", ~F.coalesce(number.between(*AGE_RANGE), F.lit(False)))]


def employee_rules(as_of=None, rules: str = FORM) -> list[tuple[str, Column]]:
    """Rules for text columns of an onboarding row (hire_date is a date).

    ``form`` is the full set for typed input. ``write`` is the weaker set in front of the
    table: no pattern for names and email, and letters of any alphabet in a role.
    """
    form = rules == FORM
    first, last, email = strip(F.col("first_name")), strip(F.col("last_name")), strip(F.col("email"))
    role, salary = strip(F.col("role")), F.col("salary").cast("string")
    letter = r"[A-Za-z]" if form else r"\p{L}"
    digits = r"\p{Nd}+"
    checks = [("first name required", is_blank(first)), ("last name required", is_blank(last))]
    if form:
        checks += [("first name not a name", ~matches(first, NAME)),
                   ("last name not a name", ~matches(last, NAME)),
                   ("email not valid", ~matches(email, EMAIL))]
    else:
        checks += [("email required", is_blank(email))]
    checks += _age_rules(F.col("age").cast("string"))
    checks += [("role required", is_blank(role)),
               ("role only digits", matches(role, digits)),
               ("role without letters", ~role.rlike(letter)),
               ("salary not a number", parse_float(salary).isNull()),
               ("salary not positive", parse_float(salary) <= 0),
               ("hire date required", F.col("hire_date").isNull()),
               ("hire date in the future", F.col("hire_date") > as_of_date(as_of))]
    return checks


def validate_employees(intake: DataFrame, as_of=None, rules: str = FORM) -> DataFrame:
    """Adds ``reject_reason``, NULL for rows that pass."""
    return intake.withColumn("reject_reason", first_broken(employee_rules(as_of, rules)))


def _known(df: DataFrame, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Mark rows whose key exists."""
    return join_found(df, known_keys(df, parent, key).withColumn(flag, F.lit(True)), key)


def _reference_rules() -> list[tuple[str, Column]]:
    return [("employee id required", is_blank(F.col("employee_id"))),
            ("unknown employee", F.col("_employee").isNull()),
            ("unknown project", F.col("_project").isNull())]


def _resolved(intake: DataFrame, employees: DataFrame, projects: DataFrame) -> DataFrame:
    typed = intake.withColumn("employee_id", F.upper(strip(F.col("employee_id"))))
    return _known(_known(typed, employees, "employee_id", "_employee"), projects, "project_id", "_project")


def validate_projects(intake: DataFrame) -> DataFrame:
    rules = [("project name required", is_blank(F.col("project_name"))),
             ("start date required", F.col("start_date").isNull())]
    return intake.withColumn("reject_reason", first_broken(rules))


def validate_assignments(intake: DataFrame, employees: DataFrame, projects: DataFrame) -> DataFrame:
    required, *references = _reference_rules()
    rules = [required, ("assignment role required", is_blank(F.col("assignment_role"))), *references]
    rows = _resolved(intake, employees, projects)
    return rows.withColumn("reject_reason", first_broken(rules)).select(*intake.columns, "reject_reason")


def validate_reviews(intake: DataFrame, employees: DataFrame, projects: DataFrame) -> DataFrame:
    outside = lambda column, limits: ~F.coalesce(F.col(column).between(*limits), F.lit(False))
    rules = [*_reference_rules(),
             ("review date required", F.col("review_date").isNull()),
             ("rating out of range", outside("rating", RATING_RANGE)),
             ("score out of range", outside("review_score", SCORE_RANGE))]
    rows = _resolved(intake, employees, projects)
    return rows.withColumn("reject_reason", first_broken(rules)).select(*intake.columns, "reject_reason")
