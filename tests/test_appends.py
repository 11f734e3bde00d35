"""Rows appended by their keys, and unique text without case."""

import pytest
from conftest import day
from pyspark.sql import functions as F

from staffmart.functions.text import insensitive, insensitive_key
from staffmart.operators.audit import BrokenRules
from staffmart.plans.appends import append_findings, append_rows, index_operational
from staffmart.plans.intake import intake_employees
from staffmart.plans.landing import audit_operational, load_operational, open_operational
from staffmart.schemas import ASSIGNMENTS, DEPARTMENTS, PROJECTS, collated
from staffmart.sources.key_index import KeyIndex
from staffmart.sources.versions import current_load


@pytest.fixture()
def store(spark, make, tmp_path):
    root = str(tmp_path / "oltp")
    staged = {"departments": make.departments("A", "B"), "employees": make.employees(*[dict(employee_id=f"E{k}") for k in range(40)]),
              "projects": spark.createDataFrame([("P1", "One", "d", day("2024-01-01"), None, "Active")], PROJECTS),
              "assignments": spark.createDataFrame([], ASSIGNMENTS), "reviews": make.reviews({}, {}, {})}
    load_operational(spark, staged, root)
    return root


def found(spark, root, table, rows, **how):
    return sorted(tuple(r) for r in append_findings(spark, root, table, rows, **how).collect())


def test_findings(spark, make, store):
    reviews = make.reviews(dict(review_id="R3"), dict(review_id="R8"), dict(review_id="R8"), dict(review_id="R9", employee_id="E99"),
                           dict(review_id="R10", project_id="P9", rating=6), dict(review_id="R11", employee_id=None))
    assert found(spark, store, "reviews", reviews, bucket_rows=3) == [
        ("reviews.employee_id not in employees", "E99", 1), ("reviews.project_id not in projects", "P9", 1),
        ("reviews.rating out of range", "R10", 1), ("reviews.review_id repeated", "R8", 2), ("reviews.review_id taken", "R3", 1)]
    people = make.employees(dict(employee_id="E1", email="new@x.co"), dict(employee_id="E100", email="e2@EXAMPLE.com", department_id=9))
    assert found(spark, store, "employees", people) == [
        ("employees.department_id not in departments", "9", 1), ("employees.email taken", "e2@EXAMPLE.com", 1),
        ("employees.employee_id taken", "E1", 1)]
    assert found(spark, store, "reviews", reviews.limit(0)) == []


def test_append(spark, make, store):
    before = open_operational(spark, store)["reviews"]
    for k in range(3):
        append_rows(spark, store, "reviews", make.reviews(*[dict(review_id=f"N{k}-{i}") for i in range(4)]), bucket_rows=4)
    append_rows(spark, store, "employees", make.employees(dict(employee_id="E100")), bucket_rows=4)
    append_rows(spark, store, "reviews", make.reviews(dict(review_id="N9", employee_id="E100")), bucket_rows=4)
    now = open_operational(spark, store)
    assert now["reviews"].count() == 16 and before.count() == 3
    assert now["employees"].where("created_at is null").count() == 0
    for table, rows in (("reviews", make.reviews(dict(review_id="N1-2"))), ("employees", make.employees(dict(employee_id="E100", email="q@q.q")))):
        version = current_load(spark, store).version
        with pytest.raises(BrokenRules, match="taken"):
            append_rows(spark, store, table, rows, bucket_rows=4)
        assert current_load(spark, store).version == version


def test_stored_rows_are_not_scanned(spark, make, store, monkeypatch):
    load = index_operational(spark, store, 4)
    rows = make.reviews(dict(review_id="N1"))
    read = []
    plain = KeyIndex._read
    monkeypatch.setattr(KeyIndex, "_read", lambda self, b: read.append(b) or plain(self, b))
    plan = append_findings(spark, store, "reviews", rows, load, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert len({p.part for p in load.of("keys")}) > 15 and max(map(len, read)) <= 3
    assert "department_name" not in plan and "hire_date" not in plan


def test_folded_keys(spark):
    words = [("Rene", 1), ("RENÉ ", 1), ("réné", 1), ("Ren", 2), ("ŠTĚPÁN", 3), ("stepan", 3), ("Ölaf", 4), ("olaf  ", 4), (None, 5)]
    df = spark.createDataFrame(words, "word string, n int").withColumn("k", insensitive_key(F.col("word")))
    assert df.select("k").distinct().count() == df.select("n").distinct().count() == 5
    assert df.groupBy(insensitive(F.col("word")).alias("c")).agg(F.count_distinct("n").alias("n")).where("n > 1").count() == 0


def test_collated_schema_and_audit(spark, make, store):
    twice = make.departments("Sales", "SALES ", "Law")
    tables = {**open_operational(spark, store), "departments": twice}
    assert audit_operational(tables).where("rule like 'departments%'").count() == 0
    row = audit_operational(tables, collation=True).where("rule like 'departments%'").first()
    assert (row.rule, row.row_count) == ("departments.department_name repeated", 2)
    typed = spark.createDataFrame(twice.collect(), collated("departments", DEPARTMENTS))
    assert typed.select("department_name").distinct().count() == 2
    assert typed.where(F.col("department_name") == "sales").count() == 2


def test_emails_without_case(spark):
    rows = [(i, "Ann", "Lee", email, "Female", "30", 1, "Analyst", "1000", day("2024-01-01")) for i, email in enumerate(
        ["A@B.co", "a@b.co", "c@d.co", "C@D.co", "x@y.co"])]
    df = spark.createDataFrame(rows, "submission_id long, first_name string, last_name string, email string, gender string, age string, "
                                     "department_id int, role string, salary string, hire_date date")
    stored = spark.createDataFrame([("E1", "X@Y.CO")], "employee_id string, email string")
    assert intake_employees(df, stored, "2025-01-01").accepted.count() == 5
    done = intake_employees(df, stored, "2025-01-01", collation=True)
    assert sorted(r.email for r in done.accepted.collect()) == ["A@B.co", "c@d.co"]
    assert {r.reject_reason for r in done.quarantine.collect()} == {"email already used"}
