import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffmart.llm import neighbours as N

KIND = "vec_id long, embedding array<float>, label int"
def ASKED():
    return F.col("vec_id") % 100 == 0



def brute_force(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    out = {}
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0])**2).sum(1))
        out[q] = [(d[p], ids[p]) for p in np.lexsort((ids, d)) if ids[p] != q][:k]
    return out


def cloud(n, length=24, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (groups, length))
    return [(k, (centres[k % groups] + rng.normal(0, 1, length)).tolist()) for k in range(n)]


def recall(rows, truth):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([k for k, _, _ in sorted(g)] == list(range(1, len(g) + 1)) for g in got.values())
    assert all([s for _, _, s in sorted(g)] == sorted(s for _, _, s in g) for g in got.values())
    hit = sum(len({v for _, v, _ in got.get(q, [])} & {v for _, v in best}) for q, best in truth.items())
    return hit / sum(map(len, truth.values()))


@pytest.mark.parametrize("how", [{}, {"cell_rows": 100, "sample_rows": 500}, {"cell_rows": 50, "most_cells": 4}])
def test_recall_against_brute_force(spark, how):
    rows = cloud(2000)
    found = N.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND), ASKED(), **how).collect()
    truth = brute_force(rows)
    assert recall(found, truth) >= 0.97
    exact = {(q, v): d for q, best in truth.items() for d, v in best}
    for r in found:
        assert r.score == pytest.approx(exact.get((r.query_id, r.vec_id), r.score), abs=1e-12)


def test_one_point_many_times_and_ties(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(700)] + [(1000, [1.0, 2.0, 3.0, 5.0])]
    found = N.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND), ASKED(), cell_rows=60).collect()
    by = {}
    for r in sorted(found, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == list(range(1, 11)) and by[100] == list(range(10)) and by[1000] == list(range(10))


def test_rows_that_take_no_part(spark):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [math.nan, 1.0]), (600, [math.inf, 1.0])]
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (None, [1.0, 0.5])]
    frame = spark.createDataFrame([(i, v, 0, "x", 2.0) for i, v in bad + rows], KIND + ", score string, cell double")
    found = sorted(N.nearest(frame, ASKED()).collect())
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 2.0)]
    assert N.nearest(frame.where("vec_id > 50"), ASKED()).count() == 0
    assert N.nearest(spark.createDataFrame([], KIND), ASKED()).count() == 0


def test_every_length_is_searched_among_its_own(spark):
    rows = [(k, [float(k), 1.0]) for k in range(0, 130, 10)] + [(k + 1, [float(k), 1.0, 2.0]) for k in range(99, 400, 50)] + [(700, [5.0])]
    found = N.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND), ASKED(), k=3).collect()
    by = {}
    for r in sorted(found, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by[0] == [(10, 10.0), (20, 20.0), (30, 30.0)]
    # 100 has a vector of each length; the smallest distances of both count.
    assert [s for _, s in by[100]] == [10.0, 10.0, 20.0] and by[200] == [(150, 50.0), (250, 50.0), (100, 100.0)]
    assert set(by) == {0, 100, 200, 300, 400}


def test_copies_in_other_batches_tie(spark):
    """Equal vectors whose projections were worked out in batches of other sizes are found as ties."""
    rng = np.random.default_rng(3)
    point = rng.normal(size=64).tolist()
    rows = [(k, point if k % 3 else rng.normal(size=64).tolist()) for k in range(1500)] + [(3000, point)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = N.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(5), ASKED(), cell_rows=100).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    copies = [k for k in range(1500) if k % 3]
    for q in (3000, 100, 200):
        assert sorted(r.vec_id for r in found if r.query_id == q) == [k for k in copies if k != q][:10]


def test_chi_square_quantile():
    draws = (np.random.default_rng(1).normal(size=(200_000, N.DIMENSIONS))**2).sum(1)
    for share in (0.5, 0.9, 0.99):
        assert abs((draws <= N.quantile(share)).mean() - share) < 0.005
