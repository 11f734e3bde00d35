"""Rows that a database would refuse stop a load; overlapping versions cost linear work."""

import datetime as dt

import pytest

from staffmart.operators.audit import BrokenRules, audit_tables, require_clean
from staffmart.operators.point_in_time import validity_segments
from staffmart.plans.landing import audit_operational, load_operational
from staffmart.plans.warehouse import DuplicateKeys, rebuild, refresh
from staffmart.schemas import ASSIGNMENTS, EMPLOYEE_HISTORY


@pytest.fixture()
def tables(spark, make):
    projects = spark.createDataFrame(
        [("P1", "One", None, dt.date(2024, 1, 1), None, "Active")],
        "project_id string, project_name string, description string, start_date date, end_date date, status string")
    return {"departments": make.departments("One", "Two"), "employees": make.employees(dict(employee_id="E1"), dict(employee_id="E2", email=None)),
            "projects": projects, "assignments": make.rows(ASSIGNMENTS, []), "reviews": make.reviews(dict(), dict(employee_id="E2")),
            "employee_history": make.rows(EMPLOYEE_HISTORY, [])}


def test_clean_tables_have_no_findings(tables):
    assert audit_operational(tables).count() == 0


def test_every_kind_of_fault_is_found(tables, make):
    tables["employees"] = make.employees(dict(employee_id="E1", department_id=9), dict(employee_id="E1", email="x"),
                                         dict(employee_id="E3", email="x"), dict(employee_id="E4", email=None), dict(employee_id="E5", email=None))
    tables["reviews"] = make.reviews(dict(review_id="R1"), dict(review_id="R1", project_id="P7"), dict(employee_id="E8", rating=6))
    found = {(r.rule, r.key, r.row_count) for r in audit_operational(tables).collect()}
    assert found == {
        ("employees.employee_id repeated", "E1", 2), ("employees.email repeated", "x", 2), ("reviews.review_id repeated", "R1", 2),
        ("employees.department_id not in departments", "9", 1), ("reviews.employee_id not in employees", "E8", 1),
        ("reviews.project_id not in projects", "P7", 1), ("reviews.rating out of range", "R3", 1)}


def test_a_load_with_faults_is_refused(spark, tables, make, tmp_path):
    tables["reviews"] = make.reviews(dict(employee_id="nobody"))
    with pytest.raises(BrokenRules, match="reviews.employee_id not in employees: nobody"):
        load_operational(spark, tables, str(tmp_path / "operational"))
    assert not (tmp_path / "operational").exists()


@pytest.mark.parametrize("table, key", [("reviews", "review_id"), ("employees", "employee_id")])
def test_repeated_keys_stop_rebuild_and_refresh(spark, tables, tmp_path, table, key):
    good = rebuild(spark, tables, str(tmp_path / "w"))
    tables[table] = tables[table].unionByName(tables[table].limit(1))
    with pytest.raises(DuplicateKeys, match=key):
        rebuild(spark, tables, str(tmp_path / "again"))
    with pytest.raises(DuplicateKeys, match=key):
        refresh(tables, good)


def test_clean_findings_raise_nothing(tables):
    require_clean(audit_tables(tables, [("projects", "project_id")], []))


def test_segments_grow_with_the_versions(spark, make):
    n, start = 300, dt.date(2024, 1, 1)
    versions = make.versions(*[dict(employee_id="E1", start_date=str(start + dt.timedelta(days=k)),
                                    end_date=str(start + dt.timedelta(days=2 * n - k))) for k in range(n)])
    rows = sorted((r.first_day, r.last_day, r.employee_sk) for r in validity_segments(versions).collect())
    assert len(rows) <= 2 * n
    assert all(a[1] + dt.timedelta(days=1) == b[0] for a, b in zip(rows, rows[1:]))
    valid = {r[0] + dt.timedelta(days=d): r[2] for r in rows for d in range((r[1] - r[0]).days + 1)}
    for k in range(2 * n + 1):
        assert valid[start + dt.timedelta(days=k)] == min(k + 1, n, 2 * n - k + 1)
