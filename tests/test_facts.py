"""Point-in-time lookup, unmatched reviews, fact merge."""

import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from staffmart.operators.point_in_time import _in_cells, validity_segments, version_counts, versions_on
from staffmart.plans.dimensions import build_dim_date, build_dim_department, build_dim_project
from staffmart.plans.facts import (
    FACT_COLUMNS, DuplicateKeys, build_fact, load_reviews, matched, merge_fact, resolve_reviews, unmatched)


def projects(spark):
    return spark.createDataFrame(
        [("P1", "One", "d", day("2024-01-01"), None, "Active"), ("P2", "One", "d", day("2024-01-01"), None, "Active")],
        "project_id string, project_name string, description string, start_date date, end_date date, status string")


def build(spark, reviews, versions):
    dim_project, dim_date = build_dim_project(projects(spark)), build_dim_date(reviews)
    return build_fact(reviews, versions, dim_project, dim_date), resolve_reviews(
        reviews, versions, dim_project, dim_date)


def test_review_on_the_shared_day_takes_the_new_version(spark, make):
    versions = make.versions(
        dict(employee_id="E1", end_date="2026-10-03", is_current=False),
        dict(employee_id="E1", start_date="2026-10-03", department_sk=2))
    reviews = make.reviews(*[dict(review_date=d) for d in ("2026-10-02", "2026-10-03", "2026-10-04")])
    fact, _ = build(spark, reviews, versions)
    got = {r.review_id: (r.employee_sk, r.department_sk) for r in fact.collect()}
    assert got == {"R1": (1, 1), "R2": (2, 2), "R3": (2, 2)}


def test_reasons_of_unmatched_reviews(spark, make):
    versions = make.versions(
        dict(employee_id="E1", start_date="2024-03-01", end_date="2024-04-30", is_current=False),
        dict(employee_id="E1", start_date="2024-06-01"))
    reviews = make.reviews(
        dict(review_date="2024-02-01"), dict(review_date="2024-05-10"), dict(review_date="2024-06-10"),
        dict(employee_id="E2"), dict(project_id="P9"))
    dim_project, dim_date = build_dim_project(projects(spark)), build_dim_date(reviews).where("full_date <> '2024-06-10'")
    resolved = resolve_reviews(reviews, versions, dim_project, dim_date)
    assert {r.review_id: r.reason for r in unmatched(resolved).collect()} == {
        "R1": "no version", "R2": "no version", "R3": "no date", "R4": "no version", "R5": "no project"}
    assert matched(resolved).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_segments_equal_brute_force_on_overlapping_versions(spark, make, seed):
    rnd = random.Random(seed)
    spans = []
    for _ in range(60):
        a, b = sorted(rnd.sample(range(1, 29), 2))
        spans.append(dict(employee_id=f"E{rnd.choice([1, 1, 1, 2, 3])}", start_date=f"2024-05-{a:02d}",
                          end_date="9999-12-31" if rnd.random() < .1 else f"2024-05-{rnd.choice([a, b]):02d}"))
    versions = make.versions(*spans)
    reviews = make.reviews(*[dict(employee_id=f"E{e}", review_date=f"2024-05-{d:02d}")
                             for e in (1, 2, 3, 4) for d in range(1, 32)])
    fact, resolved = build(spark, reviews, versions)
    got = {r.review_id: r.employee_sk for r in fact.collect()}
    want = {}
    for r in reviews.collect():
        valid = [(day(s["start_date"]), i + 1) for i, s in enumerate(spans) if s["employee_id"] == r.employee_id
                 and day(s["start_date"]) <= r.review_date <= day(s["end_date"])]
        if valid:
            want[r.review_id] = max(valid)[1]
    assert got == want
    assert fact.count() + unmatched(resolved).count() == reviews.count()
    both = validity_segments(versions).alias("a").join(
        validity_segments(versions).alias("b"), F.expr(
            "a.employee_id = b.employee_id and a.first_day < b.first_day and b.first_day <= a.last_day"))
    assert both.count() == 0


def brute_force(spans):
    """(employee, day number) to the valid version, for rows of (employee_id, start, end, key) with days as numbers."""
    want = {}
    for employee, start, end, key in spans:
        for d in range(start, min(end, 20_300) + 1):
            want[employee, d] = max(want.get((employee, d), (0, 0)), (start, key))
    return {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("seed,cell_days", [(0, 1), (1, 3), (2, 7), (3, 16), (4, 500)])
def test_versions_dealt_to_cells_equal_brute_force(spark, seed, cell_days):
    rnd, spans = random.Random(seed), set()
    for key in range(1, 150):
        start = 20_000 + int(rnd.random() ** 2 * 200)
        end = rnd.choice([start, start + rnd.randint(0, 5), start + rnd.randint(0, 250), 2_932_896])  # the last one: open end
        spans.add((rnd.choice(["E1", "E1", "E2"]), start, end, key))
    df = spark.createDataFrame(sorted(spans), "employee_id string, s int, e int, employee_sk long").select(
        "employee_id", F.date_from_unix_date("s").alias("start_date"), F.date_from_unix_date("e").alias("end_date"), "employee_sk",
        (F.col("employee_sk") % 7).alias("department_sk"))
    segments = validity_segments(df, most_versions=10, cell_days=cell_days)
    got, last = {}, {}
    for r in segments.select("employee_id", F.unix_date("first_day").alias("a"), F.unix_date("last_day").alias("b"), "employee_sk",
                             "department_sk").collect():
        assert r.department_sk == r.employee_sk % 7
        last[r.employee_id] = max(last.get(r.employee_id, 0), r.b)
        for d in range(r.a, min(r.b, 20_300) + 1):
            assert got.setdefault((r.employee_id, d), r.employee_sk) == r.employee_sk
    assert got == brute_force(spans)
    assert set(last.values()) == {2_932_896}


def test_one_employees_cells_are_in_many_tasks(spark):
    df = spark.range(3000).select(
        F.lit("E1").alias("employee_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("start_date"),
        F.date_add(F.lit("2003-01-01").cast("date"), (F.col("id") % 77).cast("int")).alias("end_date"), F.col("id").alias("employee_sk"),
        F.lit(1).cast("long").alias("department_sk"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _in_cells(df, 30).repartition("employee_id", "cell").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = sum(r["count"] for r in rows)
    assert len(rows) > 4 and max(r["count"] for r in rows) < total / 2 and total < 3000 * 3


def test_hot_employee(spark, make):
    """One employee has most reviews and a version per day; nothing is lost."""
    versions = make.versions(*[
        dict(employee_id="E1", start_date=f"2024-05-{d:02d}", end_date=f"2024-05-{d + 1:02d}", department_sk=d)
        for d in range(1, 30)])
    reviews = make.reviews(*[dict(review_date=f"2024-05-{1 + i % 29:02d}") for i in range(2000)])
    fact, _ = build(spark, reviews, versions)
    rows = fact.join(reviews.select("review_id", "review_date"), "review_id").collect()
    assert len(rows) == 2000
    assert all(r.department_sk == r.review_date.day for r in rows)
    assert sorted(r.review_sk for r in rows) == list(range(1, 2001))


def test_hot_employee_is_split(spark, make):
    """Adaptive execution splits the reviews of one employee over several tasks."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in small}
    versions = make.versions(*[dict(employee_id=f"E{i}") for i in range(40)])
    reviews = spark.range(20000).selectExpr(
        "format_string('R%d', id) AS review_id", "if(id % 3 > 0, 'E0', concat('E', id % 40)) AS employee_id",
        "'P1' AS project_id", "date_add(date'2024-02-01', cast(id % 90 AS int)) AS review_date", "3 AS rating",
        "cast(id % 100 AS decimal(6,2)) AS review_score")
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        resolved = resolve_reviews(reviews, versions, build_dim_project(projects(spark)), build_dim_date(reviews))
        rows = resolved.where("employee_sk is not null").select("review_id").collect()
        plan = resolved.where("employee_sk is not null")
        plan.collect()
        assert "SortMergeJoin(skew=true)" in plan._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 20000
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_merge_keeps_keys_and_repoints(spark, make):
    old = make.versions(dict(employee_id="E1"))
    new = make.versions(dict(employee_id="E1", end_date="2024-06-01", is_current=False),
                        dict(employee_id="E1", start_date="2024-06-01", department_sk=2))
    first = make.reviews(dict(review_date="2024-05-01"), dict(review_date="2024-07-01"))
    later = make.reviews(dict(review_date="2024-05-01"), dict(review_date="2024-07-01"),
                         dict(review_date="2024-08-01", review_score="99.50"))
    fact, _ = build(spark, first, old)
    resolved = resolve_reviews(later, new, build_dim_project(projects(spark)), build_dim_date(later))
    merged = merge_fact(fact, resolved)
    got = {r.review_id: (r.review_sk, r.employee_sk, r.action) for r in merged.collect()}
    assert got == {"R1": (1, 1, "unchanged"), "R2": (2, 2, "updated"), "R3": (3, 2, "inserted")}
    again = merge_fact(merged.select(*FACT_COLUMNS), resolved)
    assert {r.action for r in again.collect()} == {"unchanged"}
    assert again.select(*FACT_COLUMNS).exceptAll(merged.select(*FACT_COLUMNS)).count() == 0


def test_single_reviews_can_be_loaded(spark, make):
    versions = make.versions(dict(employee_id="E1"))
    reviews = make.reviews({}, {}, {})
    fact, _ = build(spark, reviews.where("review_id = 'R1'"), versions)
    ids = spark.createDataFrame([("R3",), ("R9",)], "review_id string")
    merged = load_reviews(fact, reviews, ids, versions, build_dim_project(projects(spark)), build_dim_date(reviews))
    assert sorted((r.review_id, r.action) for r in merged.collect()) == [("R1", "unchanged"), ("R3", "inserted")]


def test_a_review_given_twice_stops_the_merge(spark, make):
    versions = make.versions(dict(employee_id="E1"))
    reviews = make.reviews({}, {})
    fact, resolved = build(spark, reviews.where("review_id = 'R1'"), versions)
    dim_project, dim_date = build_dim_project(projects(spark)), build_dim_date(reviews)
    for twice in (reviews.unionByName(reviews.where("review_id = 'R1'")), reviews.unionByName(
            reviews.where("review_id = 'R2'").withColumn("rating", F.lit(1)))):
        with pytest.raises(DuplicateKeys, match="R[12]"):
            merge_fact(fact, resolve_reviews(twice, versions, dim_project, dim_date))
        with pytest.raises(DuplicateKeys):
            load_reviews(fact, twice, reviews, versions, dim_project, dim_date)
    # One that is not loaded may be repeated.
    twice = reviews.unionByName(reviews.where("review_id = 'R2'"))
    only = spark.createDataFrame([("R1",)], "review_id string")
    assert load_reviews(fact, twice, only, versions, dim_project, dim_date).count() == 1


def test_merge_numbers_new_rows_after_stored_ones(spark, make):
    versions = make.versions(dict(employee_id="E1"))
    reviews = make.reviews(*[{} for _ in range(5)])
    fact, _ = build(spark, reviews.where("review_id < 'R4'"), versions)
    merged = merge_fact(fact, build(spark, reviews, versions)[1])
    assert {(r.review_id, r.action) for r in merged.collect()} == {
        *((f"R{k}", "unchanged") for k in (1, 2, 3)), ("R4", "inserted"), ("R5", "inserted")}
    assert sorted(r.review_sk for r in merged.collect()) == [1, 2, 3, 4, 5]


def test_as_of_and_counts(spark, make):
    versions = make.versions(dict(employee_id="E1", end_date="2024-06-01", is_current=False),
                             dict(employee_id="E1", start_date="2024-06-01"), dict(employee_id="E2"))
    assert [r.employee_sk for r in versions_on(versions, "2024-06-01").orderBy("employee_sk").collect()] == [1, 2, 3]
    assert [tuple(r) for r in version_counts(versions).collect()] == [("E1", 2)]


def test_departments_get_dense_keys(make):
    rows = build_dim_department(make.departments("B", "A", "C")).orderBy("department_sk").collect()
    assert [(r.department_sk, r.department_id) for r in rows] == [(1, 1), (2, 2), (3, 3)]
