"""Generated data: sizes, ranges, shares, and the same rows under any partitioning."""

import pytest
from pyspark.sql import functions as F

from staffmart.plans.synth import Generator, load_seed
from staffmart.plans.synth_values import DEPARTMENTS, PROJECTS, ROLES
from staffmart.session import shared_dir
from staffmart.sources.tables import write_csv


@pytest.fixture(scope="module")
def made(spark):
    return {name: df.cache() for name, df in Generator(spark, load_seed(spark), 5000).tables().items()}


def test_seed(spark):
    seed = load_seed(spark, "/nowhere/seed.csv").selectExpr("*", "cast(Age as int) a", "cast(YearsAtCompany as int) y",
                                                            "cast(MonthlyIncome as int) m")
    assert seed.count() == 1470
    assert seed.where("a between 21 and 60 and y between 0 and least(25, a - 18) and m between 25000 and 220000").count() == 1470
    assert 0.15 < seed.where("Attrition = 'Yes'").count() / 1470 < 0.25


def test_seed_file(spark, tmp_path):
    write_csv(load_seed(spark).limit(10), str(tmp_path / "seed.csv"))
    assert load_seed(spark, str(tmp_path / "seed.csv")).count() == 10


def test_sizes(made):
    n = {name: df.count() for name, df in made.items()}
    assert n["departments"] == 6 and n["projects"] == 10 and n["employees"] == 5000
    assert n["employee_history"] == 500 and n["reviews"] == 500 + 5000 + 5000
    assert 1.3 < n["assignments"] / 5000 < 1.4
    for name, key in [("employees", "employee_id"), ("assignments", "assignment_id"), ("reviews", "review_id")]:
        assert made[name].select(key).distinct().count() == n[name]


def test_ranges(made):
    e = made["employees"]
    assert e.where("age not between 21 and 65 or salary < 240000 or year(hire_date) not between 1995 and 2025").count() == 0
    assert e.where("employee_id <= 'E000500' and year(hire_date) > 2023").count() == 0
    assert {r.department_name for r in e.select("department_name").distinct().collect()} == {d[1] for d in DEPARTMENTS}
    r = made["reviews"]
    assert r.where("rating not between 1 and 5 or review_score not between 35 and 99").count() == 0
    assert r.where("cast(left(comments, 4) as int) <> year(review_date)").count() == 0
    assert r.where("abs(rating - review_score / 20) > 0.501").count() == 0


def test_past_versions_hold_the_reviews_of_2024(made):
    h = made["employee_history"].join(made["employees"].select("employee_id", "hire_date", F.col("department_id").alias("now")), "employee_id")
    assert h.where("start_date < hire_date or start_date > '2024-06-01' or end_date <> '2024-12-31'").count() == 0
    assert h.where("department_id <> now % 6 + 1").count() == 0
    early = made["reviews"].where("year(review_date) = 2024").join(h.select("employee_id", "start_date", "end_date"), "employee_id")
    assert early.count() == 500
    assert early.where("review_date not between start_date and end_date").count() == 0


def test_shares(made):
    counts = {r.project_id: r["count"] for r in made["assignments"].groupBy("project_id").count().collect()}
    total = sum(counts.values())
    for i, (_, share) in enumerate(PROJECTS):
        assert abs(counts[f"P{i + 1:04d}"] / total - share / 100) < 0.02
    means = {r.department_name: r.m for r in made["reviews"].where("year(review_date) = 2025").join(
        made["employees"], "employee_id").groupBy("department_name").agg(F.avg("review_score").alias("m")).collect()}
    assert means["Engineering"] > means["Marketing"] > means["Finance"] > means["Sales"]
    spread = made["reviews"].where("year(review_date) = 2025").join(made["employees"].where("department_name = 'Finance'"), "employee_id")
    assert 5 < spread.agg(F.stddev("review_score")).first()[0] < 11


def test_same_rows_under_any_partitioning(spark, made):
    for size in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", size)
        again = Generator(spark, load_seed(spark).repartition(int(size)), 5000).tables()
        for name in ("employees", "assignments", "reviews"):
            assert again[name].exceptAll(made[name]).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_more_rows_keep_the_people(spark, made):
    bigger = Generator(spark, load_seed(spark), 5000, min_rows=6000)
    assert bigger.rows == 6000
    same = bigger.employees().where("employee_id <= 'E000500'").select("employee_id", "first_name", "salary", "hire_date")
    assert same.exceptAll(made["employees"].select(*same.columns)).count() == 0


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
