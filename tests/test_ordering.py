"""Positions, neighbours and tiles, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from staffmart.operators.ordering import (
    closed_up, number_chunks, sorted_chunks, with_next, with_position, with_previous, with_tile, with_tile_of_levels)


def skewed(spark, n=4000):
    """Two thirds of the rows have the key 'hot'."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 50}", rnd.randrange(200), i) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, at int, id int")


@pytest.fixture(params=["true", "false"])
def many_chunks(request, spark):
    """With and without merging of small partitions, so that borders between chunks matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_position_is_dense_and_sorted(spark, many_chunks):
    rows, df = skewed(spark)
    got = {r.id: r.n for r in with_position(df, "n", ["key", "at", "id"], start=11).collect()}
    assert got == {r[2]: i + 11 for i, r in enumerate(sorted(rows))}


def test_position_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    _, df = skewed(spark)
    chunks = sorted_chunks(df, ["key", "at", "id"]).groupBy("_chunk").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(chunks) == 8
    assert max(r["count"] for r in chunks) < 4000 / 3


def test_position_of_nothing(spark):
    df = spark.createDataFrame([], "key string")
    assert with_position(df, "n", ["key"]).collect() == []


def test_neighbours(spark, many_chunks):
    rows, df = skewed(spark)
    rows.sort()
    chunks = sorted_chunks(df, ["key", "at", "id"])
    both = with_next(with_previous(chunks, "key", "id", "before"), "key", "id", "after")
    got = {r.id: (r.before, r.after) for r in both.collect()}
    for i, (key, _, id_) in enumerate(rows):
        before = rows[i - 1][2] if i and rows[i - 1][0] == key else None
        after = rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][0] == key else None
        assert got[id_] == (before, after)


def test_neighbours_after_a_filter_that_empties_chunks(spark, many_chunks):
    rows, df = skewed(spark)
    kept = sorted(r for r in rows if r[0] != "hot" or r[1] in (0, 199))
    chunks = sorted_chunks(df, ["key", "at", "id"]).where("key <> 'hot' or at in (0, 199)")
    got = {r.id: (r.n, r.after) for r in number_chunks(
        closed_up(with_next(chunks, "key", "id", "after")), "n").collect()}
    for i, (key, _, id_) in enumerate(kept):
        after = kept[i + 1][2] if i + 1 < len(kept) and kept[i + 1][0] == key else None
        assert got[id_] == (i + 1, after)


def test_neighbour_value_may_be_null(spark, many_chunks):
    df = spark.range(100).select(F.lit("a").alias("key"), "id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = {r.id: r.before for r in with_previous(sorted_chunks(df, ["key", "id"]), "key", "v", "before").collect()}
    assert got == {i: i - 1 if i and (i - 1) % 2 == 0 else None for i in range(100)}


@pytest.mark.parametrize("n", [1, 7, 20, 23, 100, 1999])
def test_tiles_equal_ntile(spark, n):
    df = spark.range(n).select((F.col("id") * 37 % 10).alias("score"), "id")
    ours = with_tile(df, "t", 20, [F.desc("score"), "id"]).collect()
    df.createOrReplaceTempView("tiles")
    theirs = spark.sql("SELECT score, id, ntile(20) OVER (ORDER BY score DESC, id) AS t FROM tiles").collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, theirs))


@pytest.mark.parametrize("levels", [1, 3, 60, 5000])
@pytest.mark.parametrize("tiles", [1, 7, 20])
def test_tiles_of_levels_equal_ntile(spark, levels, tiles):
    rnd = random.Random(levels)
    df = spark.createDataFrame([(i, rnd.randrange(levels) / 4) for i in rnd.sample(range(10**6), 700)], "id long, score double")
    order = [F.desc("score"), "id"]
    got = {r.id: r.tile for r in with_tile_of_levels(df, "tile", tiles, "score", "id").collect()}
    assert got == {r.id: r.tile for r in df.select("id", F.ntile(tiles).over(Window.orderBy(*order)).alias("tile")).collect()}
    assert with_tile_of_levels(df.limit(0), "tile", tiles, "score", "id").count() == 0


def test_rows_off_the_borders_are_not_sorted(spark):
    """With as many rows in each level as in a tile no border runs through a level, and nothing is range-partitioned."""
    df = spark.range(200).select("id", (F.col("id") % 10).alias("score"))
    tiled = with_tile_of_levels(df, "tile", 10, "score", "id")
    assert {(r.score, r.tile) for r in tiled.collect()} == {(s, 10 - s) for s in range(10)}
    plan = tiled._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "RepartitionByExpression" not in plan
