"""Department changes in batches against a one-by-one replay."""

import random

import pytest
from conftest import day

from staffmart.operators.audit import audit_versions
from staffmart.operators.scd2 import DAY_BEFORE, SAME_DAY, apply_department_changes
from staffmart.plans.dimensions import build_dim_department

CHANGES = "employee_id string, new_department_id int, effective_date date, change_id long"


def setup(spark, make, changes, employees=("E10001",)):
    people = make.employees(*[dict(employee_id=e) for e in employees])
    versions = make.versions(*[dict(employee_id=e) for e in employees])
    departments = build_dim_department(make.departments("Engineering", "Finance", "Sales"))
    rows = spark.createDataFrame([(e, d, day(t), i) for i, (e, d, t) in enumerate(changes)], CHANGES)
    return versions, rows, people, departments


@pytest.mark.parametrize("policy,end", [(SAME_DAY, "2026-10-03"), (DAY_BEFORE, "2026-10-02")])
def test_worked_example(spark, make, policy, end):
    args = setup(spark, make, [("E10001", 2, "2026-10-03")])
    result = apply_department_changes(*args, policy)
    rows = [(r.employee_sk, r.department_sk, str(r.start_date), str(r.end_date), r.is_current)
            for r in result.dim_employee.orderBy("employee_sk").collect()]
    assert rows == [(1, 1, "2024-01-01", end, False), (2, 2, "2026-10-03", "9999-12-31", True)]
    assert result.employees.first().department_id == 2
    assert result.rejects.count() == 0


def test_no_op_and_rejects(spark, make):
    args = setup(spark, make, [
        ("E10001", 1, "2026-01-01"), ("E9", 2, "2026-01-01"), ("E10001", 9, "2026-01-01"),
        ("E10001", 2, "2023-01-01"), ("E2", 2, "2026-01-01")], ("E10001", "E2"))
    versions = args[0].where("employee_id = 'E10001'")
    result = apply_department_changes(versions, *args[1:])
    assert result.dim_employee.count() == 1
    assert {r.change_id: r.reject_reason for r in result.rejects.collect()} == {
        1: "unknown employee", 2: "unknown department", 3: "effective before current start",
        4: "no current version"}


def test_new_versions_take_the_attributes_of_the_employee_row(spark, make):
    versions, changes, _, departments = setup(spark, make, [("E10001", 3, "2026-01-01")])
    people = make.employees(dict(employee_id="E10001", role="Lead", first_name="Bea"))
    result = apply_department_changes(versions, changes, people, departments)
    rows = result.dim_employee.orderBy("employee_sk").collect()
    assert [(r.first_name, r.role) for r in rows] == [("Ann", "Analyst"), ("Bea", "Lead")]


def replay(changes, employees, policy):
    """One change after the other, in order of date and id."""
    versions = {e: [[1, "2024-01-01", "9999-12-31"]] for e in employees}
    for e, d, t in sorted(changes, key=lambda c: (c[0], c[2], changes.index(c))):
        now = versions[e][-1]
        if now[0] != d:
            now[2] = t
            versions[e].append([d, t, "9999-12-31"])
    return sorted((e, *v) for e, vs in versions.items() for v in vs)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_batch_equals_replay_with_a_hot_employee(spark, make, coalesce):
    rnd = random.Random(3)
    people = [f"E{i}" for i in range(6)]
    changes, seen = [], set()
    for i in range(600):
        e = "E0" if i % 3 else rnd.choice(people)
        change = (e, rnd.randint(1, 3), f"2025-0{rnd.randint(1, 9)}-{rnd.randint(1, 28):02d}")
        changes.append(change) if change not in seen else None
        seen.add(change)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    result = apply_department_changes(*setup(spark, make, changes, people))
    got = sorted((r.employee_id, r.department_sk, str(r.start_date), str(r.end_date))
                 for r in result.dim_employee.collect())
    assert got == replay(changes, people, SAME_DAY)
    assert audit_versions(result.dim_employee).count() == 0
    keys = sorted(r.employee_sk for r in result.dim_employee.collect())
    assert keys == list(range(1, len(got) + 1))
    last = {e: d for e, d, s, t in got if t == "9999-12-31"}
    assert {r.employee_id: r.department_id for r in result.employees.collect()} == last
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_day_before_keeps_the_last_change_of_a_day(spark, make):
    changes = [("E10001", 2, "2026-01-05"), ("E10001", 3, "2026-01-05"), ("E10001", 1, "2026-02-01")]
    result = apply_department_changes(*setup(spark, make, changes), DAY_BEFORE)
    rows = [(r.department_sk, str(r.start_date), str(r.end_date))
            for r in result.dim_employee.orderBy("start_date").collect()]
    assert rows == [(1, "2024-01-01", "2026-01-04"), (3, "2026-01-05", "2026-01-31"),
                    (1, "2026-02-01", "9999-12-31")]


def test_audit_finds_broken_histories(make):
    broken = make.versions(
        dict(employee_id="E1"), dict(employee_id="E1", start_date="2025-01-01"),
        dict(employee_id="E2", start_date="2024-05-01", end_date="2024-04-01", is_current=False),
        dict(employee_id="E3"))
    got = {(r.employee_id, r.rule, r.row_count) for r in audit_versions(broken).collect()}
    assert got == {("E1", "current versions", 2), ("E1", "overlap", 1),
                   ("E2", "current versions", 0), ("E2", "start after end", 1)}
