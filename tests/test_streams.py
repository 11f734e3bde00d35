"""Streams against batches, and what a micro-batch reads and writes."""

import itertools
import pathlib

import pytest
from conftest import day
from pyspark.sql import functions as F

from staffmart.operators.scd2 import DAY_BEFORE, SAME_DAY, apply_department_changes
from staffmart.plans.dimensions import build_dim_department
from staffmart.plans.intake import intake_assignments, intake_employees, intake_projects, intake_reviews
from staffmart.sources.key_index import TABLE as KEYS
from staffmart.sources.versions import current_load, publish
from staffmart.streaming.changes import VERSIONS_LOG, changed_tables, department_change_stream, fold
from staffmart.streaming.intake import file_stream, intake_stream

EMPLOYEE_FORM = ("submission_id long, first_name string, last_name string, email string, gender string, age string, "
                 "department_id int, role string, salary string, hire_date date")


def form(i, email=None, age="30"):
    return (i, "Ann", "Lee", email or f"e{i}@example.com", "Female", age, 1, "Analyst", "1000", day("2024-01-01"))


def results(result):
    return (sorted(map(str, result[0].collect())), sorted(map(str, result[1].collect())))


class Stream:
    def __init__(self, spark, tmp_path, schema, judge, unique=(), bucket_rows=3):
        self.spark, self.source, self.root = spark, str(tmp_path / "in"), str(tmp_path / "out")
        self.checkpoint, self.schema, self.judge, self.unique, self.bucket_rows = str(tmp_path / "cp"), schema, judge, unique, bucket_rows

    def send(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        self.run()

    def run(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        stream = file_stream(self.spark, self.source, schema, files_per_batch=1)
        intake_stream(stream, self.root, self.judge, self.checkpoint, self.unique, self.unique, self.bucket_rows).awaitTermination()

    def got(self):
        return [self.spark.read.parquet(f"{self.root}/{name}").drop("batch") for name in ("accepted", "quarantine")]


def test_rows_without_an_id_and_repeated_ids(spark, tmp_path):
    """As the batch judges them: rows without an id are refused one by one, of equal ids the smallest row counts."""
    judge = lambda new, stored: intake_employees(new, stored, "2025-01-01")
    rows = [form(None), form(None), form(None, "x@example.com"), form(7, "b@example.com"), form(7, "a@example.com"), form(8)]
    stream = Stream(spark, tmp_path, EMPLOYEE_FORM, judge, ["email"])
    stream.send(rows)
    batch = judge(spark.createDataFrame(rows, EMPLOYEE_FORM), None)
    assert results(stream.got()) == results([batch.accepted, batch.quarantine])
    assert sorted(r.email for r in stream.got()[0].collect()) == ["a@example.com", "e8@example.com"]
    assert stream.got()[1].count() == 3


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    judge = lambda new, stored: intake_employees(new, stored, "2025-01-01")
    rows = [form(i, f"e{i % 17}@example.com", "x" if i % 5 == 0 else "30") for i in range(60)]
    stream = Stream(spark, tmp_path, EMPLOYEE_FORM, judge, ["email"])
    for k in range(0, 60, 12):
        stream.send(rows[k:k + 12])
        stream.send(rows[max(0, k - 5):k + 1])  # delivered again
    batch = judge(spark.createDataFrame(rows, EMPLOYEE_FORM), None)
    assert results(stream.got()) == results([batch.accepted, batch.quarantine])


def test_other_kinds(spark, make, tmp_path):
    people = make.employees(dict(employee_id="E1"), dict(employee_id="E2"))
    projects = spark.createDataFrame([("P1", "One", "d", day("2024-01-01"), None, "Active")],
                                     "project_id string, project_name string, description string, start_date date, end_date date, status string")
    kinds = {
        "projects": ("submission_id long, project_name string, description string, start_date date, end_date date, status string",
                     [(i, ["A", " "][i % 4 == 0], "d", day("2024-01-01"), None, "Planned") for i in range(12)],
                     lambda new, stored: intake_projects(new, stored)),
        "assignments": ("submission_id long, employee_id string, project_id string, assignment_role string, start_date date",
                        [(i, f"e{i % 3}", "P1", "Lead", day("2024-01-01")) for i in range(12)],
                        lambda new, stored: intake_assignments(new, people, projects, stored)),
        "reviews": ("submission_id long, employee_id string, project_id string, review_date date, rating int, review_score decimal(6,2), comments string",
                    [(i, "E1", "P1", day("2024-01-01"), i % 7, None if i % 5 == 0 else 50, "c") for i in range(12)],
                    lambda new, stored: intake_reviews(new, people, projects, stored))}
    for name, (schema, rows, judge) in kinds.items():
        frame = spark.createDataFrame([(i, *map(lambda v: __import__("decimal").Decimal(v) if name == "reviews" and v == 50 else v, r)) for i, *r in rows], schema)
        rows = [tuple(r) for r in frame.collect()] + [(None, *tuple(frame.first())[1:])] * 2
        stream = Stream(spark, tmp_path / name, schema, judge)
        stream.send(rows[:5])
        stream.send(rows[3:])
        batch = judge(spark.createDataFrame(rows, schema), None)
        assert results(stream.got()) == results([batch.accepted, batch.quarantine]), name


def test_a_late_batch_reads_what_an_early_one_read(spark, tmp_path, monkeypatch):
    """Buckets read and written by batches of equal size, with more and more stored."""
    from staffmart.sources.key_index import KeyIndex
    read, plain = [], KeyIndex._read
    monkeypatch.setattr(KeyIndex, "_read", lambda self, b: read.append(sum(len(self.pieces.get(x, ())) for x in b)) or plain(self, b))
    judge = lambda new, stored: intake_employees(new, stored, "2025-01-01")
    stream = Stream(spark, tmp_path, EMPLOYEE_FORM, judge, ["email"], bucket_rows=4)
    stream.send([form(i) for i in range(300)])
    sizes, written = [], []
    for k in range(3):
        read.clear()
        before = set(current_load(spark, stream.root).of(KEYS))
        stream.send([form(1000 + 1000 * k), form(1001 + 1000 * k)])
        sizes.append(sum(read))
        written.append(len(set(current_load(spark, stream.root).of(KEYS)) - before))
        stream.send([form(100_000 + 300 * k + i) for i in range(150)])
    assert max(sizes) <= 12 + 4 and max(written) <= 8
    assert len(current_load(spark, stream.root).of(KEYS)) > 150


def test_an_entered_batch_is_not_judged_again(spark, tmp_path):
    judged = []

    def judge(new, stored):
        judged.append(1)
        return intake_projects(new, stored)

    schema = "submission_id long, project_name string, description string, start_date date, end_date date, status string"
    stream = Stream(spark, tmp_path, schema, judge)
    rows = [(1, "A", "d", day("2024-01-01"), None, "Planned")]
    stream.send(rows)
    # The stream forgets that it has done the batch; the log has not.
    stream.checkpoint += "-lost"
    stream.run()
    assert judged == [1] and stream.got()[0].count() == 1


def changes(rows):
    return [(f"E{e}", d, day(t), i) for i, (e, d, t) in enumerate(rows, 1)]


FIELDS = "employee_id string, new_department_id int, effective_date date, change_id long"


@pytest.mark.parametrize("policy", [SAME_DAY, DAY_BEFORE])
def test_change_log_equals_one_batch(spark, make, tmp_path, policy):
    people = make.employees(*[dict(employee_id=f"E{k}") for k in range(1, 6)])
    versions = make.versions(*[dict(employee_id=f"E{k}") for k in range(1, 5)])
    departments = build_dim_department(make.departments("A", "B", "C"))
    rows = changes([(1, 2, "2025-01-01"), (2, 3, "2025-01-02"), (1, 2, "2025-02-01"), (1, 3, "2025-02-01"), (9, 1, "2025-02-02"),
                    (1, 1, "2025-03-01"), (2, 9, "2025-03-01"), (5, 1, "2025-03-02"), (3, 2, "2023-01-01"), (2, 1, "2025-04-01"),
                    (1, 2, "2025-05-05"), (4, 2, "2025-05-06"), (1, 3, "2025-05-07")])
    rows.sort(key=lambda r: (r[2], r[3]))
    root, source = str(tmp_path / "dw"), str(tmp_path / "in")
    publish({"dim_employee": versions, "employees": people}, root)
    days = [list(own) for _, own in itertools.groupby(rows, key=lambda r: r[2])]
    for k in range(0, len(days), 3):
        sent = spark.createDataFrame([r for own in days[k:k + 3] for r in own], FIELDS)
        sent.coalesce(1).write.mode("append").parquet(source)
        stream = file_stream(spark, source, sent.schema, files_per_batch=1)
        department_change_stream(stream, root, departments, str(tmp_path / "cp"), policy, fold_after=2, bucket_rows=2).awaitTermination()
    whole = apply_department_changes(versions, spark.createDataFrame(rows, FIELDS), people, departments, policy)

    def plain(result):
        return [sorted(map(str, f.collect())) for f in (
            result.dim_employee.drop("employee_sk"), result.employees, result.rejects.select("change_id", "reject_reason"))]

    now = changed_tables(spark, root)
    assert plain(now) == plain(whole)
    keys = [r.employee_sk for r in now.dim_employee.collect()]
    assert len(keys) == len(set(keys))
    fold(spark, root)
    assert plain(changed_tables(spark, root)) == plain(whole)
    assert current_load(spark, root).of(VERSIONS_LOG) == []


def test_a_change_writes_its_own_rows_only(spark, make, tmp_path):
    people = make.employees(*[dict(employee_id=f"E{k}") for k in range(200)])
    versions = make.versions(*[dict(employee_id=f"E{k}") for k in range(200)])
    departments = build_dim_department(make.departments("A", "B", "C"))
    root, source = str(tmp_path / "dw"), str(tmp_path / "in")
    publish({"dim_employee": versions, "employees": people}, root)
    before = current_load(spark, root)
    rows = []
    for k in range(3):
        sent = spark.createDataFrame(changes([(7, 2 + k % 2, f"2025-0{k + 1}-01")]), FIELDS)
        sent.coalesce(1).write.mode("append").parquet(source)
        old = {p: p.stat().st_size for p in pathlib.Path(root).rglob("*.parquet")}
        stream = file_stream(spark, source, sent.schema, files_per_batch=1)
        department_change_stream(stream, root, departments, str(tmp_path / "cp"), bucket_rows=10).awaitTermination()
        new = [p for p in pathlib.Path(root).rglob("*.parquet") if p not in old]
        rows.append(sum(spark.read.parquet(str(p)).count() for p in new))
    assert rows[1] <= 10 and rows[2] <= 10  # closed, opened, moved, state
    load = current_load(spark, root)
    assert load.of("dim_employee") == before.of("dim_employee") and load.of("employees") == before.of("employees")
    assert changed_tables(spark, root).dim_employee.where(F.col("employee_id") == "E7").count() == 4
