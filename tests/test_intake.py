"""Validation, audits, intake and streams."""

import pytest
from conftest import day
from pyspark.sql import functions as F

from staffmart.functions.text import insensitive
from staffmart.operators import audit
from staffmart.operators.validate import FORM, WRITE, validate_employees
from staffmart.plans.intake import intake_assignments, intake_employees, intake_projects, intake_reviews
from staffmart.plans.synth import keep_review_year
from staffmart.plans.dimensions import build_dim_department
from staffmart.schemas import EMPLOYEES
from staffmart.sources.tables import nulls_for_missing, work_path
from staffmart.sources.versions import publish
from staffmart.streaming.changes import changed_tables, department_change_stream
from staffmart.streaming.intake import file_stream, intake_stream

GOOD = dict(first_name="Ann", last_name="O'Neil-Ray", email="a.b+c@ex-ample.co", age="30", role="Lead 2",
            salary="1000.50", hire_date="2024-01-01")
FIELDS = ("submission_id long, first_name string, last_name string, email string, gender string, age string, "
          "department_id int, role string, salary string, hire_date date")


def forms(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        r = {**GOOD, "email": f"e{i}@example.com", **change}
        rows.append((i, r["first_name"], r["last_name"], r["email"], "Female", r["age"], r.get("department_id", 1), r["role"], r["salary"],
                     r["hire_date"] and day(r["hire_date"])))
    return spark.createDataFrame(rows, FIELDS)


CASES = [
    ({}, None, None), (GOOD, None, None),
    (dict(first_name=" \t"), "first name required", "first name required"),
    (dict(last_name=None), "last name required", "last name required"),
    (dict(first_name="A1"), "first name not a name", None),
    (dict(last_name="-x"), "last name not a name", None),
    (dict(first_name="Zoë"), "first name not a name", None),
    (dict(first_name=" Mary Ann "), None, None),
    (dict(email="no-at"), "email not valid", None),
    (dict(email="a@b.c"), "email not valid", None),
    (dict(email="a@b.co\n"), None, None),
    (dict(email=" "), "email not valid", "email required"),
    (dict(age="abc"), "age not an integer", "age not an integer"),
    (dict(age="18.9"), "age not an integer", "age not an integer"),
    (dict(age=None), "age not an integer", "age not an integer"),
    (dict(age="17"), "age out of range", "age out of range"),
    (dict(age="18"), None, None), (dict(age=" 70 "), None, None),
    (dict(age="71"), "age out of range", "age out of range"),
    (dict(age="-20"), "age out of range", "age out of range"),
    (dict(age="9" * 50), "age out of range", "age out of range"),
    (dict(role=""), "role required", "role required"),
    (dict(role="123"), "role only digits", "role only digits"),
    (dict(role="---"), "role without letters", "role without letters"),
    (dict(role="été"), None, None),
    (dict(role="Ж"), "role without letters", None),
    (dict(salary="abc"), "salary not a number", "salary not a number"),
    (dict(salary="NaN"), "salary not a number", "salary not a number"),
    (dict(salary="1e5"), None, None),
    (dict(salary="0"), "salary not positive", "salary not positive"),
    (dict(salary="-1"), "salary not positive", "salary not positive"),
    (dict(hire_date=None), "hire date required", "hire date required"),
    (dict(hire_date="2025-01-02"), "hire date in the future", "hire date in the future"),
    (dict(hire_date="2025-01-01"), None, None),
    (dict(first_name="", age="abc"), "first name required", "first name required"),
]


@pytest.mark.parametrize("rules,column", [(FORM, 1), (WRITE, 2)])
def test_rules(spark, rules, column):
    judged = validate_employees(forms(spark, *[c[0] for c in CASES]), "2025-01-01", rules)
    got = {r.submission_id: r.reject_reason for r in judged.collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[column], case


def test_accepted_employees(spark, make):
    stored = make.employees(dict(employee_id="E1", email="taken@example.com"))
    result = intake_employees(forms(
        spark, dict(first_name=" Ann "), dict(email=" twice@example.com"), dict(email="twice@example.com"),
        dict(email="taken@example.com")), stored, "2025-01-01")
    rows = result.accepted.collect()
    assert result.accepted.columns == EMPLOYEES.names
    assert {(r.first_name, r.age, str(r.salary), r.status) for r in rows} == {("Ann", 30, "1000.50", "Active")}
    assert sorted(r.employee_id for r in rows) == ["E-0", "E-1"]
    assert sorted(r.email for r in rows) == ["e0@example.com", "twice@example.com"]
    assert {r.submission_id: r.reject_reason for r in result.quarantine.collect()} == {
        2: "email already used", 3: "email already used"}


def test_each_submission_is_taken_in_once(spark, make):
    one = forms(spark, dict(), dict(email="other@example.com"), dict(department_id=9))
    unnamed = one.limit(1).withColumn("submission_id", F.lit(None).cast("long")).withColumn("email", F.lit("n@example.com"))
    given = one.unionByName(one).unionByName(one.withColumn("role", F.lit("Zoologist"))).unionByName(unnamed)
    stored = make.employees(dict(employee_id="E-1", email="before@example.com"))
    result = intake_employees(given, stored, "2025-01-01", departments=make.departments("One"))
    assert [(r.employee_id, r.role) for r in result.accepted.collect()] == [("E-0", one.first().role)]
    assert {(r.submission_id, r.reject_reason) for r in result.quarantine.collect()} == {
        (1, "already taken in"), (2, "unknown department"), (None, "submission id required")}
    assert result.quarantine.count() == 3

    projects = spark.createDataFrame([(k, "P", None, day("2024-01-01"), None, "Planned") for k in (5, 5, 6)],
                                     "submission_id long, project_name string, description string, start_date date, "
                                     "end_date date, status string")
    first = intake_projects(projects)
    assert sorted(r.project_id for r in first.accepted.collect()) == ["P-5", "P-6"]
    again = intake_projects(projects, first.accepted.where("project_id = 'P-5'"))
    assert [r.project_id for r in again.accepted.collect()] == ["P-6"]
    assert [r.reject_reason for r in again.quarantine.collect()] == ["already taken in"]


def test_other_forms(spark, make):
    people = make.employees(dict(employee_id="E1"))
    projects = spark.createDataFrame(
        [(1, " One ", " d ", day("2024-01-01"), None, "Planned"), (2, " ", "d", day("2024-01-01"), None, "Planned"),
         (3, "No start", "d", None, None, "Planned")],
        "submission_id long, project_name string, description string, start_date date, end_date date, status string")
    done = intake_projects(projects)
    assert [(r.project_name, r.description) for r in done.accepted.collect()] == [("One", "d")]
    assert {r.submission_id: r.reject_reason for r in done.quarantine.collect()} == {
        2: "project name required", 3: "start date required"}
    known = done.accepted
    pid = known.first().project_id

    assignments = spark.createDataFrame(
        [(1, " e1 ", pid, " Lead "), (2, " ", pid, "x"), (3, "E1", pid, " "), (4, "E7", pid, "x"), (5, "E1", "P", "x")],
        "submission_id long, employee_id string, project_id string, assignment_role string"
    ).withColumn("start_date", F.lit("2024-02-01").cast("date"))
    done = intake_assignments(assignments, people, known)
    assert [(r.employee_id, r.assignment_role, r.end_date) for r in done.accepted.collect()] == [("E1", "Lead", None)]
    assert {r.submission_id: r.reject_reason for r in done.quarantine.collect()} == {
        2: "employee id required", 3: "assignment role required", 4: "unknown employee", 5: "unknown project"}

    reviews = spark.createDataFrame(
        [(1, "e1", 5, "100"), (2, "E1", 0, "50"), (3, "E1", 6, "50"), (4, "E1", 3, "100.01"), (5, "E1", 3, "-1"),
         (6, None, 3, "1"), (7, "E1", None, "1")],
        "submission_id long, employee_id string, rating int, score string").select(
        "submission_id", "employee_id", F.lit(pid).alias("project_id"), F.lit("2024-02-01").cast("date").alias("review_date"),
        "rating", F.col("score").cast("decimal(6,2)").alias("review_score"), F.lit(" ok ").alias("comments"))
    done = intake_reviews(reviews, people, known)
    assert [(r.employee_id, r.comments) for r in done.accepted.collect()] == [("E1", "ok")]
    assert {r.submission_id: r.reject_reason for r in done.quarantine.collect()} == {
        2: "rating out of range", 3: "rating out of range", 4: "score out of range", 5: "score out of range",
        6: "employee id required", 7: "rating out of range"}


def test_audits(spark, make):
    people = make.employees(dict(employee_id="E1"), dict(employee_id="E1", email=None), dict(employee_id="E2", role="x" * 121))
    assert [tuple(r) for r in audit.audit_unique(people, "employee_id").collect()] == [("E1", 2)]
    found = {r.column_name: (r.missing, r.too_long) for r in audit.audit_not_null(people, EMPLOYEES).collect()}
    assert found["email"] == (1, 0) and found["role"] == (0, 1) and found["gender"] == (0, 0)
    reviews = make.reviews({}, dict(employee_id="E9"), dict(employee_id="E9", rating=6), dict(employee_id=None, rating=None))
    assert [tuple(r) for r in audit.audit_references(reviews, people, "employee_id").collect()] == [("E9", 2)]
    assert [r.review_id for r in audit.audit_check(reviews, audit.rating_in_range()).collect()] == ["R3"]


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"), "NaN"), (1.0, ""), (None, "NaT"), (2.0, "x")], "a double, b string")
    assert [tuple(r) for r in nulls_for_missing(df).collect()] == [(None, None), (1.0, None), (None, None), (2.0, "x")]


def test_insensitive_grouping(spark):
    df = spark.createDataFrame([("Rene",), ("RENÉ ",), ("Ren",)], "name string")
    assert df.select(insensitive(F.col("name")).alias("n")).distinct().count() == 2
    assert df.distinct().count() == 3


def test_reviews_move_into_their_year(make):
    reviews = make.reviews(
        dict(review_date="2023-05-01", comments="2024 performance review"),
        dict(review_date="2024-05-01", comments="2024 performance review"),
        dict(review_date="2023-05-01", comments="2024 performance review, late"))
    got = {r.review_id: str(r.review_date) for r in keep_review_year(reviews).collect()}
    assert got["R1"].startswith("2024") and got["R2"] == "2024-05-01" and got["R3"] == "2023-05-01"


def test_stream_equals_batch_and_survives_repeats(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = forms(spark, {}, dict(age="x"), dict(email="same@example.com"))
    judge = lambda new, stored: intake_employees(new, stored, "2025-01-01")

    def run():
        stream = file_stream(spark, source, rows.schema, files_per_batch=1)
        intake_stream(stream, root, judge, str(tmp_path / "checkpoint"), ["email"]).awaitTermination()
        return (sorted(r.email for r in spark.read.parquet(f"{root}/accepted").collect()),
                sorted((r.submission_id, r.reject_reason) for r in spark.read.parquet(f"{root}/quarantine").collect()))

    rows.coalesce(1).write.parquet(source)
    first = run()
    assert first == (["e0@example.com", "same@example.com"], [(1, "age not an integer")])
    assert run() == first  # nothing new
    rows.coalesce(1).write.mode("append").parquet(source)  # delivered again
    assert run() == first
    late = rows.where("submission_id = 2").withColumn("submission_id", F.lit(9).cast("long"))
    late.coalesce(1).write.mode("append").parquet(source)
    assert run() == (first[0], first[1] + [(9, "email already used")])


def test_change_stream_equals_batches(spark, make, tmp_path):
    people = make.employees(dict(employee_id="E1"), dict(employee_id="E2"))
    versions = make.versions(dict(employee_id="E1"), dict(employee_id="E2"))
    departments = build_dim_department(make.departments("A", "B", "C"))
    root, source = str(tmp_path / "dw"), str(tmp_path / "in")
    publish({"dim_employee": versions, "employees": people}, root)
    fields = "employee_id string, new_department_id int, effective_date date, change_id long"

    def send(*rows):
        spark.createDataFrame([(e, d, day(t), i) for i, e, d, t in rows], fields).coalesce(1).write.mode("append").parquet(source)
        stream = file_stream(spark, source, spark.createDataFrame([], fields).schema, files_per_batch=1)
        department_change_stream(stream, root, departments, str(tmp_path / "checkpoint")).awaitTermination()
        return changed_tables(spark, root)

    send((1, "E1", 2, "2025-01-01"), (2, "E2", 3, "2025-01-01"))
    now = send((3, "E1", 3, "2025-03-01"), (4, "E2", 1, "2024-12-01"))
    rows = sorted((r.employee_id, r.department_sk, str(r.start_date), str(r.end_date)) for r in now.dim_employee.collect())
    assert rows == [("E1", 1, "2024-01-01", "2025-01-01"), ("E1", 2, "2025-01-01", "2025-03-01"),
                    ("E1", 3, "2025-03-01", "9999-12-31"), ("E2", 1, "2024-01-01", "2025-01-01"),
                    ("E2", 3, "2025-01-01", "9999-12-31")]
    assert [(r.change_id, r.reject_reason) for r in now.rejects.collect()] == [(4, "effective before current start")]
    assert {r.employee_id: r.department_id for r in now.employees.collect()} == {"E1": 3, "E2": 3}
