"""Reports on small warehouses with known answers."""

import dataclasses
from decimal import Decimal

import pytest
from conftest import day
from pyspark.sql import functions as F

from staffmart.functions.dates import completed_years
from staffmart.plans import reports, sums
from staffmart.plans.dimensions import build_dim_date, build_dim_department, build_dim_project
from staffmart.plans.facts import build_fact
from staffmart.plans.warehouse import Warehouse, open_warehouse, publish_refresh, rebuild, refresh
from staffmart.schemas import EMPLOYEE_HISTORY
from staffmart.sources.versions import current_load


def project_rows(spark):
    return spark.createDataFrame(
        [("P1", "Same", None, day("2024-01-01"), None, "Active"), ("P2", "Same", None, day("2024-01-01"), None, "Active")],
        "project_id string, project_name string, description string, start_date date, end_date date, status string")


def warehouse(spark, make, versions, reviews, departments=("Engineering", "Finance")):
    dim_employee = make.versions(*versions)
    given = make.reviews(*reviews)
    dim_project, dim_date = build_dim_project(project_rows(spark)), build_dim_date(given)
    return Warehouse(build_dim_department(make.departments(*departments)), dim_project, dim_date, dim_employee,
                     build_fact(given, dim_employee, dim_project, dim_date))


def people(n, **more):
    return [dict(employee_id=f"E{i:02d}", **more) for i in range(n)]


def test_rank_ties_are_kept(spark, make):
    w = warehouse(spark, make, people(5), [dict(employee_id=f"E{i:02d}", review_score=s)
                                           for i, s in enumerate(["90", "90", "80", "70", "60"])])
    rows = reports.top_employees(w).collect()
    assert [(r.performance_rank, r.avg_score) for r in rows] == [
        (1, Decimal(90)), (1, Decimal(90)), (2, Decimal(80)), (3, Decimal(70))]
    assert [r.performance_rank for r in reports.top_employees_by_sk(w).collect()] == [1, 1, 2, 3]


def test_top_list_by_name_merges_departments_of_one_name(spark, make):
    versions = [dict(employee_id="E1"), dict(employee_id="E2", department_sk=2)]
    w = warehouse(spark, make, versions, [dict(employee_id="E1", review_score="90"), dict(employee_id="E2", review_score="80")],
                  ("Sales", "Sales"))
    assert [r.performance_rank for r in reports.top_employees(w).collect()] == [1, 2]
    assert [r.performance_rank for r in reports.top_employees_by_sk(w).collect()] == [1, 1]


def test_mean_is_not_rounded_in_the_top_list(spark, make):
    w = warehouse(spark, make, people(1), [dict(employee_id="E00", review_score=s) for s in ("80", "80", "81")])
    assert reports.top_employees(w).first().avg_score == Decimal("80.333333")
    assert reports.yearly_trend(w).first().avg_score == Decimal("80.33")


def test_projects_of_one_name(spark, make):
    versions = [dict(employee_id="E1", end_date="2024-05-31", is_current=False),
                dict(employee_id="E1", start_date="2024-06-01")]
    w = warehouse(spark, make, versions, [
        dict(project_id="P1", review_date="2024-05-01"), dict(project_id="P2", review_date="2024-07-01"),
        dict(project_id="P1", review_date="2024-08-01", review_score="81.01")])
    row = reports.project_bottlenecks(w).collect()
    assert [tuple(r) for r in row] == [("Same", 2, 3, Decimal("80.34"))]
    assert reports.project_bottlenecks(w, by="employee_id").first().employee_count == 1
    ids = [tuple(r)[:4] for r in reports.project_bottlenecks_by_id(w).collect()]
    assert ids == [("P1", "Same", 2, 2), ("P2", "Same", 1, 1)]


def test_kpis_and_departments(spark, make):
    versions = [dict(employee_id="E1"), dict(employee_id="E2", department_sk=2),
                dict(employee_id="E2", start_date="2020-01-01", end_date="2020-12-31", is_current=False)]
    w = warehouse(spark, make, versions, [{}, dict(employee_id="E2", review_score="90.01")])
    assert tuple(reports.kpis(w).first()) == (2, 2, Decimal("85.01"), Decimal("170.01"))
    assert [tuple(r) for r in reports.department_performance(w).collect()] == [
        ("Finance", 1, Decimal("90.01")), ("Engineering", 1, Decimal("80.00"))]


def test_empty_fact(spark, make):
    w = warehouse(spark, make, people(1), [dict(employee_id="E99")])
    assert tuple(reports.kpis(w).first()) == (1, 0, None, None)
    assert reports.yearly_trend(w).collect() == []
    assert reports.top_employees(w).collect() == []


def test_risk_of_an_employee_without_reviews(spark, make):
    w = warehouse(spark, make, [dict(employee_id="E1", hire_date="2021-01-01", salary="250000")],
                  [dict(employee_id="E9")])
    row = reports.attrition_risk(w, "2024-06-01").first()
    assert (row.years_at_company, row.avg_score, row.risk_score) == (3, None, Decimal("43.00"))


@pytest.mark.parametrize("years,points", [(0, 8), (1, 8), (2, 10), (5, 10), (6, 5), (10, 5), (11, 2)])
@pytest.mark.parametrize("salary,pay", [("299999.99", 15), ("300000", 10), ("400000", 5), ("500000", 0)])
def test_risk_points(spark, make, years, points, salary, pay):
    versions = make.versions(dict(employee_id="E1", hire_date=f"{2020 - years}-01-01", salary=salary))
    w = Warehouse(None, None, None, versions, spark.createDataFrame(
        [(1, Decimal("88.88"))], "employee_sk long, review_score decimal(6,2)"))
    assert reports.risk_scores(w, "2020-06-01").first().risk_score == Decimal("6.67") + points + pay


def test_fewer_employees_than_tiles(spark, make):
    w = warehouse(spark, make, people(7), [dict(employee_id="E00")])
    got = {r.risk_level: r.employee_count for r in reports.attrition_distribution(w, "2024-06-01").collect()}
    assert got == {"High": 4, "Medium": 3, "Low": 0}


def test_absent_levels_are_listed(spark, make):
    w = warehouse(spark, make, people(2), [dict(employee_id="E00")])
    rows = [tuple(r) for r in reports.attrition_distribution(w, "2024-06-01").collect()]
    assert rows == [("High", 2), ("Medium", 0), ("Low", 0)]


def test_shares_with_everyone_on_one_score(spark, make):
    """The hardest tie: all employees have the same score."""
    w = warehouse(spark, make, people(100), [dict(employee_id="E999")])
    rows = reports.attrition_risk(w, "2024-06-01").collect()
    assert {r.risk_score for r in rows} == {rows[0].risk_score}
    levels = {r.employee_id: r.risk_level for r in rows}
    assert levels["E19"] == "High" and levels["E20"] == "Medium" and levels["E74"] == "Medium" and levels["E75"] == "Low"
    assert [r.employee_id for r in reports.attrition_top(w, "2024-06-01", 3).collect()] == ["E00", "E01", "E02"]


@pytest.mark.parametrize("start,end,years", [
    ("2020-02-29", "2021-02-28", 0), ("2020-02-29", "2021-03-01", 1), ("2020-02-29", "2024-02-29", 4),
    ("2020-05-05", "2021-05-04", 0), ("2020-05-05", "2021-05-05", 1)])
def test_completed_years(spark, start, end, years):
    df = spark.range(1).select(completed_years(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("y"))
    assert df.first().y == years


def test_operational_reports(spark, make):
    departments = make.departments("B", "A")
    employees = make.employees(dict(employee_id="E2"), dict(employee_id="E1", department_id=2), dict(employee_id="E3", department_id=9))
    rows = reports.employee_directory(employees, departments, 2).collect()
    assert [(r.employee_id, r.employee_name, r.department_name) for r in rows] == [("E1", "Ann E1", "A"), ("E2", "Ann E2", "B")]
    assert [r.department_name for r in reports.department_list(departments).collect()] == ["A", "B"]
    assert [r.project_id for r in reports.project_list(project_rows(spark)).collect()] == ["P1", "P2"]
    assert reports.employee_lookup(spark, employees, "E3").first().department_id == 9
    assert reports.employee_lookup(spark, employees, "x' OR '1'='1").count() == 0
    ids = spark.createDataFrame([("E1",), ("E1",), ("Q",)], "employee_id string")
    assert {tuple(r) for r in reports.employee_exists(ids, employees).collect()} == {("E1", True), ("Q", False)}


def test_reports_from_kept_sums(spark, make, tmp_path):
    """After refreshes that touch some years, the kept sums answer as the facts do, without reading them."""
    base = {"departments": make.departments("A", "B"), "projects": project_rows(spark),
            "employees": make.employees(*[dict(employee_id=f"E{k}", department_id=1 + k % 2, hire_date="2020-01-01") for k in range(9)]),
            "employee_history": spark.createDataFrame([], EMPLOYEE_HISTORY)}
    rows = [dict(employee_id=f"E{k % 9}", project_id=f"P{1 + k % 2}", review_date=f"{2021 + k % 4}-0{1 + k % 9}-01",
                 review_score=str(50 + k % 47)) for k in range(60)]
    root = str(tmp_path / "dw")
    rebuild(spark, {**base, "reviews": make.reviews(*rows[:40])}, root, "2020-01-01", keep_sums=True)
    before = current_load(spark, root)
    moved = [dict(r, review_date="2021-02-02") if i == 3 else r for i, r in enumerate(rows[:41])]
    for given in (moved, moved + rows[41:]):
        publish_refresh(refresh({**base, "reviews": make.reviews(*given)}, open_warehouse(spark, root)), root)
        now = open_warehouse(spark, root)
        plain = dataclasses.replace(now, sums=None)
        for report in (reports.kpis, reports.yearly_trend, reports.top_employees, reports.top_employees_by_sk, reports.project_bottlenecks,
                       reports.project_bottlenecks_by_id, reports.department_performance,
                       lambda w: reports.attrition_risk(w, "2025-01-01")):
            assert [tuple(r) for r in report(now).collect()] == [tuple(r) for r in report(plain).collect()]
            assert "review_id" not in report(now)._jdf.queryExecution().optimizedPlan().toString()
            assert not any("/fact/" in f for f in report(now).inputFiles())
        if given is moved:
            # Review 41 is of 2021, and the moved one went from 2024 to 2021: 2022 and 2023 are shared.
            shared = {p.part for p in current_load(spark, root).of("people_by_project") if p in before.pieces}
            assert shared == {"2022", "2023"}


def test_bitmaps_of_many_buckets(spark):
    keys = [1, 2, 32_768, 32_769, 10**9, 10**9 + 1, 2]
    fact = spark.createDataFrame([(2020 + i % 3, 1, k) for i, k in enumerate(keys * 3)], "year_num int, project_sk long, employee_sk long")
    people = sums._people(fact)
    assert people.count() > 3
    assert [tuple(r) for r in sums.people_per_project(people, "project_sk").collect()] == [(1, 6)]
