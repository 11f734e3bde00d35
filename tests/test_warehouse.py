"""Rebuild, refresh, dimensions and publication."""

import datetime as dt
import pathlib
import random

import pytest
from conftest import day
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from staffmart.operators.merge import upsert
from staffmart.plans.dimensions import (
    MissingReference, append_new_employees, build_dim_date, build_dim_department, build_dim_employee,
    extend_dim_date, new_employees)
from staffmart.plans.landing import load_operational, load_staging, read_files, write_files
from staffmart.plans.synth import Generator, load_seed
from staffmart.plans import warehouse
from staffmart.plans.warehouse import (
    DuplicateKeys, load_summary, open_warehouse, publish_refresh, rebuild, refresh)
from staffmart.schemas import EMPLOYEE_HISTORY, PROJECTS, STAR
from staffmart.sources.tables import work_path
from staffmart.sources.versions import current, current_load, enter, new_folder, publish, remove_old_loads


@pytest.fixture(scope="module")
def tables(spark):
    made = Generator(spark, load_seed(spark), 300).tables()
    return {name: df.cache() for name, df in made.items()}


def sets(w):
    return {name: sorted(map(str, getattr(w, name).select(*STAR[name].names).collect())) for name in STAR}


def test_rebuild_twice_gives_the_same_tables(spark, tables, tmp_path):
    first = sets(rebuild(spark, tables, str(tmp_path / "dw")))
    shuffled = {n: df.repartition(3, F.rand(1)) for n, df in tables.items()}
    assert sets(rebuild(spark, shuffled, str(tmp_path / "dw"))) == first
    assert current(spark, str(tmp_path / "dw"))[0] == 2
    assert sets(open_warehouse(spark, str(tmp_path / "dw"))) == first


def test_refresh_of_a_complete_warehouse_changes_nothing(spark, tables, tmp_path):
    w = rebuild(spark, tables, str(tmp_path / "dw"))
    once = refresh(tables, w)
    summary = {r.table_name: r.row_count for r in once.summary().collect()}
    facts = w.fact.count()
    assert summary == {"departments_synced": 6, "projects_synced": 10, "dates_added": 0, "new_employees": 0,
                       "reviews_inserted": 0, "reviews_updated": 0, "reviews_unchanged": facts}
    assert sets(once.warehouse) == sets(w)


def test_refresh_from_a_part_equals_rebuild_up_to_keys(spark, tables, tmp_path):
    early = {**tables, "reviews": tables["reviews"].where("review_date < date'2025-06-01'"),
             "employees": tables["employees"].where("employee_id < 'E000200'")}
    root = str(tmp_path / "dw")
    result = refresh(tables, rebuild(spark, early, root))
    publish_refresh(result, root)
    part, whole = open_warehouse(spark, root), rebuild(spark, tables, str(tmp_path / "whole"))

    def facts(w):
        versions = w.dim_employee.select("employee_sk", "employee_id", "start_date")
        return sorted(map(str, w.fact.drop("review_sk", "employee_sk").join(
            w.fact.select("review_id", "employee_sk").join(versions, "employee_sk").drop("employee_sk"),
            "review_id").collect()))

    assert facts(part) == facts(whole)
    again = refresh(tables, part)
    assert sets(again.warehouse) == sets(part)


def files(root, load, table):
    """Names of the data files of a table, by part."""
    return {p.part: sorted(f.name for f in (pathlib.Path(root) / p.path).iterdir() if f.suffix == ".parquet") for p in load.of(table)}


@pytest.mark.parametrize("moved_to", ["2024-07-01", "2025-07-01"])
def test_a_refresh_writes_only_touched_years(spark, make, tmp_path, moved_to):
    root = str(tmp_path / "dw")
    base = {"departments": make.departments("A"), "employees": make.employees(dict(employee_id="E1", hire_date="2020-01-01")),
            "projects": spark.createDataFrame([("P1", "One", "d", day("2024-01-01"), None, "Active")], PROJECTS),
            "employee_history": spark.createDataFrame([], EMPLOYEE_HISTORY)}
    first = make.reviews(*[dict(review_date=d) for d in ("2022-01-01", "2023-01-01", "2024-01-01")])
    rebuild(spark, {**base, "reviews": first}, root, "2020-01-01")
    before = current_load(spark, root)
    reader = open_warehouse(spark, root)
    later = make.reviews(*[dict(review_date=d) for d in ("2022-01-01", "2023-01-01", moved_to, "2023-05-05")])
    publish_refresh(refresh({**base, "reviews": later}, reader), root)
    after = current_load(spark, root)
    touched = {"2023", "2024", moved_to[:4]}
    assert {p.part for p in after.of("fact")} == {"2022", "2023", moved_to[:4]}
    for piece in after.of("fact"):
        assert (piece in before.of("fact")) == (piece.part not in touched)
    assert files(root, after, "fact")["2022"] == files(root, before, "fact")["2022"]
    assert before.of("dim_employee") == after.of("dim_employee")
    assert len(after.of("dim_date")) == 2
    # Who opened the load before still reads it; who opens now reads the new one.
    assert sorted(r.year_num for r in reader.fact.collect()) == [2022, 2023, 2024]
    rows = {r.review_id: r.year_num for r in open_warehouse(spark, root).fact.collect()}
    assert rows == {"R1": 2022, "R2": 2023, "R3": int(moved_to[:4]), "R4": 2023}
    pruned = open_warehouse(spark, root).fact.where("year_num = 2023").select("review_id")
    assert "PartitionFilters: [isnotnull(year_num" in pruned._jdf.queryExecution().executedPlan().toString()

    stamp = {p: p.stat().st_mtime for p in (tmp_path / "dw").rglob("*.parquet")}
    publish_refresh(refresh({**base, "reviews": later}, open_warehouse(spark, root)), root)
    assert current_load(spark, root).of("fact") == after.of("fact")
    assert all("fact" not in str(p) for p in (tmp_path / "dw").rglob("*.parquet") if p not in stamp)
    assert remove_old_loads(spark, root) == []  # too young to go
    assert remove_old_loads(spark, root, older_than=-60)
    assert {r.review_id: r.year_num for r in open_warehouse(spark, root).fact.collect()} == rows
    assert len(list((tmp_path / "dw" / "versions").iterdir())) == 1


def test_grown_tables_are_written_anew_at_times(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(warehouse, "MOST_PIECES", 2)
    root = str(tmp_path / "dw")
    base = {"departments": make.departments("A"), "reviews": make.reviews(dict(employee_id="E1")),
            "projects": spark.createDataFrame([("P1", "One", "d", day("2024-01-01"), None, "Active")], PROJECTS),
            "employee_history": spark.createDataFrame([], EMPLOYEE_HISTORY)}
    people = [dict(employee_id=f"E{k}") for k in range(1, 6)]
    rebuild(spark, {**base, "employees": make.employees(people[0])}, root, "2024-01-01")
    pieces = []
    for n in range(2, 6):
        publish_refresh(refresh({**base, "employees": make.employees(*people[:n])}, open_warehouse(spark, root)), root)
        pieces.append(len(current_load(spark, root).of("dim_employee")))
        assert open_warehouse(spark, root).dim_employee.count() == n
    assert pieces == [2, 1, 2, 1]


def test_of_two_writers_after_one_load_the_second_fails(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = spark.range(3)
    publish({"a": rows}, root)
    load = current_load(spark, root)
    folder = new_folder(root)
    enter(spark, root, folder, load.pieces, {"seen": 7}, after=load.version)
    with pytest.raises(AnalysisException):
        enter(spark, root, new_folder(root), load.pieces, after=load.version)
    assert current_load(spark, root).notes == {"seen": "7"} and current(spark, root) == (2, folder)


def test_load_summary_counts_written_facts(spark, tables, tmp_path):
    w = rebuild(spark, tables, str(tmp_path / "dw"))
    got = {r.table_name: r.row_count for r in load_summary(tables, w).collect()}
    assert got["reviews"] == 630 and got["facts"] == w.fact.count() <= 630
    assert got["historical_versions"] == 30 and got["current_versions"] == 300


def test_files_to_staging_to_operational(spark, tables, tmp_path):
    write_files(tables, str(tmp_path / "files"))
    staging = load_staging(spark, str(tmp_path / "files"), str(tmp_path / "staging"))
    for name, df in tables.items():
        assert sorted(map(str, staging[name].collect())) == sorted(map(str, df.select(*staging[name].columns).collect()))
    operational = load_operational(spark, staging, str(tmp_path / "oltp"))
    assert "department_name" not in operational["employees"].columns
    assert operational["employees"].where("created_at is null or updated_at is null").count() == 0


def test_missing_files_are_all_named(spark, tmp_path):
    (tmp_path / "employees.csv").write_text("employee_id\n")
    with pytest.raises(FileNotFoundError) as error:
        read_files(spark, str(tmp_path))
    assert "departments.csv" in str(error.value) and "employee_history.csv" in str(error.value)
    assert "employees.csv," not in str(error.value)


def test_half_finished_load_is_not_visible(spark, tables, tmp_path):
    root = str(tmp_path / "dw")
    w = rebuild(spark, tables, root)
    broken = {**tables, "employees": tables["employees"].withColumn("department_id", F.lit(99))}
    with pytest.raises(MissingReference, match="99"):
        rebuild(spark, broken, root)
    assert sets(open_warehouse(spark, root)) == sets(w)


def test_history_of_unknown_employee_is_an_error(spark, tables):
    departments = build_dim_department(tables["departments"])
    with pytest.raises(MissingReference, match="E000001"):
        build_dim_employee(tables["employees"].where("employee_id > 'E000005'"), tables["employee_history"], departments)


def test_current_start_defaults_to_the_day_after_the_past(spark, tables):
    dim = build_dim_employee(tables["employees"], tables["employee_history"], build_dim_department(tables["departments"]))
    starts = {r.start_date for r in dim.where("is_current").join(
        tables["employee_history"].select("employee_id"), "employee_id").collect()}
    assert starts == {day("2025-01-01")}
    past = dim.where("not is_current").agg(F.min("employee_sk"), F.max("employee_sk")).first()
    assert tuple(past) == (1, 30)


def test_calendar_dense_or_observed(spark, make):
    reviews = make.reviews(dict(review_date="2024-02-27"), dict(review_date="2024-03-01"))
    dense = build_dim_date(reviews)
    assert [r.date_sk for r in dense.orderBy("date_sk").collect()] == [20240227, 20240228, 20240229, 20240301]
    more = make.reviews(dict(review_date="2024-03-01"), dict(review_date="2024-12-31"))
    row = extend_dim_date(dense, more).where("date_sk > 20240301").collect()
    assert [tuple(r) for r in row] == [(20241231, day("2024-12-31"), 31, 12, "December", 4, 2024)]
    assert build_dim_date(reviews.limit(0)).count() == 0


def test_upsert(spark, make):
    old = build_dim_department(make.departments("A", "B"))
    changed = make.departments("A", "New", "C", "D").where("department_id <> 1")
    rows = {r.department_id: (r.department_sk, r.department_name)
            for r in upsert(old, changed, "department_id", "department_sk").collect()}
    assert rows == {1: (1, "A"), 2: (2, "New"), 3: (3, "C"), 4: (4, "D")}


def test_upsert_takes_nulls(spark, make):
    old = build_dim_department(make.departments("A"))
    rows = upsert(old, make.departments("A").withColumn("location", F.lit(None).cast("string")),
                  "department_id", "department_sk").collect()
    assert rows[0].location is None


def test_duplicate_departments_stop_a_refresh(spark, tables, tmp_path):
    w = rebuild(spark, tables, str(tmp_path / "dw"))
    twice = {**tables, "departments": tables["departments"].unionByName(tables["departments"])}
    with pytest.raises(DuplicateKeys):
        refresh(twice, w)


def test_known_employees_are_left_alone(spark, make):
    departments = build_dim_department(make.departments("A", "B"))
    dim = make.versions(dict(employee_id="E1", role="Old"))
    people = make.employees(dict(employee_id="E1", role="New"), dict(employee_id="E2", department_id=2, hire_date="2025-05-05"))
    assert [r.employee_id for r in new_employees(dim, people).collect()] == ["E2"]
    rows = append_new_employees(dim, people, departments).orderBy("employee_sk").collect()
    assert [(r.employee_sk, r.role, r.department_sk, str(r.start_date)) for r in rows] == [
        (1, "Old", 1, "2024-01-01"), (2, "Analyst", 2, "2025-05-05")]
    with pytest.raises(MissingReference):
        append_new_employees(dim, make.employees(dict(employee_id="E3", department_id=7)), departments)
