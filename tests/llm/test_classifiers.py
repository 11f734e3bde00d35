import numpy as np
import pytest
from pyspark.sql import functions as F

from staffmart.llm import quality as Q
from staffmart.llm import toxicity as X
from staffmart.llm.common import first_by_hash, held_out
from tests.llm.helpers import awkward, documents, nothing, prose

def HOLD():
    return held_out("doc_id", 4, 2)

BAD = ["idiot", "scum", "moron", "trash"]
LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=240):
    texts, labels = [], []
    for k in range(n):
        good, toxic = k % 3 != 0, k % 4 == 0
        own = prose(k, 30 + k % 40).split()
        if not good:
            own = [w + "$%&#"[j % 4] * 3 for j, w in enumerate(own)]
        if toxic:
            for j in range(1 + k % 7):
                own.insert((j * 11) % len(own), BAD[(k + j) % 4])
        texts.append(" ".join(own))
        labels.append((k + 1, int(good), int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def given(spark):
    return corpus(spark)


def test_quality_of_held_out_rows(spark, given):
    docs, labels = given
    rows = Q.classify(docs, labels, HOLD()).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_does_not_see_held_out_labels(spark, given):
    docs, labels = given
    wrong = labels.withColumn("quality", F.when(HOLD(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(Q.classify(docs, labels, HOLD()).collect()) == sorted(Q.classify(docs, wrong, HOLD()).collect())


def test_hinge_loss_is_at_its_minimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1, -1)
    scale, penalty = rng.normal(0, 1, 30), np.full(60, 0.7)
    x = np.zeros((60, 31))
    for k, r in enumerate(rows):
        x[k, r] = Q.unit(scale[r])
    x[:, 30] = 1

    def loss(w):
        return w @ w / 2 + (penalty * np.maximum(0, 1 - y * (x @ w))).sum()

    weights, bias = Q.hinge(rows, y, scale, penalty, rounds=400)
    best = np.append(weights, bias)
    assert all(loss(best) <= loss(best + rng.normal(0, s, 31)) + 1e-6 for s in (0.3, 0.03, 0.003) for _ in range(50))


def test_indicators_are_distinct_per_text():
    maker = Q.Indicators()
    features, offsets = maker.of([b"a b a b", b"", b"a b a b", b"A"])
    sets = [features[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert sets[0] == sets[2] == sorted(set(sets[0])) and sets[1] == [] and sets[3]


def test_toxicity_of_held_out_rows(spark, given):
    docs, labels = given
    truth = labels.select("doc_id", F.col("toxic").alias("y"))
    rows = X.grade(docs, labels, HOLD()).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.toxic == (r.y == 1) for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.severity <= X.GRADES - 1 and 0 <= r.grade < X.GRADES for r in rows)
    few = [r.severity for r in rows if r.y and (r.doc_id - 1) % 7 <= 1]
    many = [r.severity for r in rows if r.y and (r.doc_id - 1) % 7 >= 5]
    assert np.mean(many) > np.mean(few)


def test_ordinal_thresholds_stay_in_order_and_fit_the_shares():
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=3000), 3000
    grade = np.searchsorted([-0.5, 0.5, 2.0], 1.5 * x + rng.logistic(size=n))
    model = X.Ordinal.fit(np.arange(n), np.zeros(n, int), x, grade, 1, np.ones(n), steps=600)
    assert (np.diff(model.thresholds) > 0).all()
    assert np.allclose(model.thresholds, [-0.5, 0.5, 2.0], atol=0.25) and abs(model.weights[0] - 1.5) < 0.2
    p = model.grades(model.weights[0] * x)
    assert np.allclose(p.sum(1), 1) and np.allclose(p.mean(0), np.bincount(grade) / n, atol=0.02)


def test_one_id_very_often_changes_nothing(spark, given):
    """The sample has each id once, so copies of one take no places from others."""
    docs, labels = given
    many = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(3000)).drop("id"))
    sampled, count = Q.sample(many, labels.unionByName(labels), "quality", ~HOLD(), 40)
    plain, _ = Q.sample(docs, labels, "quality", ~HOLD(), 40)
    assert sorted(sampled.collect()) == sorted(plain.collect()) and plain.count() == 40
    for run in (Q.classify, X.grade):
        assert sorted(run(many, labels, HOLD()).distinct().collect()) == sorted(run(docs, labels, HOLD()).collect())


@pytest.mark.parametrize("most", [0, 1, 7, 300, 10_000])
def test_first_by_hash(spark, most):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("kind"), F.lit("x").alias("more"))
    want = {}
    for r in rows.select("kind", "doc_id", F.xxhash64("doc_id").alias("h")).collect():
        want.setdefault(r.kind, []).append((r.h % 2**64, r.doc_id))  # the first bits count without a sign
    got = {}
    for r in first_by_hash(rows, "kind", "doc_id", most).collect():
        got.setdefault(r.kind, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(i for _, i in sorted(v)[:most]) for k, v in want.items() if most}
    assert first_by_hash(rows, "kind", "doc_id", most).columns == rows.columns


@pytest.mark.parametrize("run", [Q.classify, X.grade])
def test_awkward_rows(spark, run):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (99, 0, 0)], LABELS)
    rows = run(docs, labels, HOLD()).collect()
    assert len(rows) == docs.count()
    assert run(nothing(spark), labels, HOLD()).count() == 0
    assert run(docs, labels.where("doc_id > 1000"), HOLD()).count() == docs.count()


def test_without_labels(spark):
    docs = documents(spark, ["a", None])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in Q.classify(docs, none, HOLD()).collect()} == {0.5}
    assert {r.severity for r in X.grade(docs, none, HOLD()).collect()} == {0.0}
