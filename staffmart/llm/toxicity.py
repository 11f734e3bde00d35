"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

Grades run from 0 (clean) to 3. One weight vector is shared by all grades; ordered thresholds
cut its score into grades, P(grade > k) being the logistic function of score - threshold k. The
output is the expected grade, the likeliest one, and whether any toxicity is likelier than none.

A feature is a word with the value 1 + log2(its count). Words are chosen by a chi-square test of
presence against the label. Labels say only toxic or not, so toxic rows are graded by the
number of marker words (chosen words at least ``MARKED`` times as frequent in toxic rows): up to one is grade
1, up to four grade 2, more grade 3. A table with grades may be given instead.

Learning uses a bounded sample, chosen by a hash of the id: ``fit_rows`` rows, half from each class where there
are enough, and the ``most_words`` words with the highest test values.

Words are lower-cased (A-Z) runs without white space and ASCII punctuation. Null and empty
texts have no features and get the grade of the thresholds alone. Without labels of both classes every
severity is 0. Rows that repeat give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import pieces, raw_texts, values
from staffmart.llm.decontaminate import words
from staffmart.llm.quality import sample

GRADES = 4
FIT_ROWS, MOST_WORDS = 10_000, 20_000
CHI_SQUARE, LEAST_ROWS, MARKED = 20.0, 3, 10.0
RIDGE, STEPS, RATE = 0.05, 400, 0.1


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that hold a word, for the words of one task's sampled rows."""
    seen = (Counter(), Counter())
    for batch in pieces(batches):
        for label, text in zip(values(batch, "label").to_pylist(), raw_texts(batch)):
            seen[label].update(set(words(text)))
    known = list(seen[0] | seen[1])
    yield pa.RecordBatch.from_arrays([
        pa.array(known, pa.binary()), pa.array([seen[0][w] for w in known], pa.int64()),
        pa.array([seen[1][w] for w in known], pa.int64())], names=["word", "clean", "toxic"])


def _counted(send, carried: list[str]):
    """Rows as (places, counts) of known words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: k for k, w in enumerate(send.value)}
        for batch in pieces(batches):
            found = [Counter(k for k in map(known.get, words(t)) if k is not None) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([
                *(values(batch, c) for c in carried),
                pa.array([list(c) for c in found], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                names=[*carried, "places", "counts"])
    return run


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Ordinal:
    """Shared weights and increasing thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, owner: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int,
            weight: np.ndarray, grades: int = GRADES, ridge: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> Ordinal:
        """Maximum likelihood with a ridge, by Adam on the whole sample.

        Thresholds are a first one and the logarithms of the gaps, so they stay in order.
        """
        n = len(grade)
        w = np.zeros(features)
        above = np.array([(weight * (grade > k)).sum() + 1 for k in range(grades - 1)]) / (weight.sum() + 2)
        start = -np.log(above / (1 - above))
        t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
        first, second = np.zeros(features + grades - 1), np.zeros(features + grades - 1)
        rows = np.arange(n)
        for step in range(1, steps + 1):
            theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
            score = np.bincount(owner, w[place] * value, n)
            cut = _logistic(score[:, None] - theta[None, :])  # P(grade > k)
            cut = np.concatenate([np.ones((n, 1)), cut, np.zeros((n, 1))], 1)
            p = np.maximum(cut[rows, grade] - cut[rows, grade + 1], 1e-12)
            slope = cut * (1 - cut)
            d_score = weight * (slope[rows, grade] - slope[rows, grade + 1]) / p
            d_cut = np.zeros((n, grades + 1))
            d_cut[rows, grade] -= weight * slope[rows, grade] / p
            d_cut[rows, grade + 1] += weight * slope[rows, grade + 1] / p
            d_theta = d_cut[:, 1:grades].sum(0)
            down = np.cumsum(d_theta[::-1])[::-1]
            d_t = np.concatenate([down[:1], down[1:] * np.exp(t[1:])])
            d_w = np.bincount(place, d_score[owner] * value, features) - ridge * w
            gradient = np.concatenate([d_w, d_t]) / n
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient * gradient
            move = rate * (1 - step / steps) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            w += move[:features]
            t += move[features:]
        return cls(w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        above = _logistic(score[:, None] - self.thresholds[None, :])
        above = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], 1)
        return above[:, :-1] - above[:, 1:]


def train(documents: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", fit_rows: int = FIT_ROWS,
          most_words: int = MOST_WORDS) -> tuple[list[bytes], Ordinal] | None:
    rows, count = sample(documents, labels, column, learn, fit_rows)
    if len(count) < 2:
        return None
    rows = rows.select("doc_id", "label", "text")
    n0, n1 = (float(min(count[c], fit_rows // 2)) for c in (0, 1))
    seen = rows.mapInArrow(_presence, "word binary, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
    a, b = F.col("toxic"), F.col("clean")
    test = (F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2)) * (n0 + n1)) / (
        n0 * n1 * (a + b) * F.greatest(F.lit(0.5), n0 + n1 - a - b))
    chosen = seen.withColumn("test", test).where(F.col("test") >= CHI_SQUARE).orderBy(F.desc("test"), "word").limit(most_words).collect()
    vocabulary = [bytes(r["word"]) for r in chosen]
    marker = np.array([(r["toxic"] + 0.5) / n1 >= MARKED * (r["clean"] + 0.5) / n0 for r in chosen], bool)
    send = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(documents.dtypes)["doc_id"]
    found = rows.mapInArrow(_counted(send, ["doc_id", "label"]), f"doc_id {kind}, label int, places array<int>, counts array<int>")
    found = sorted(found.collect(), key=lambda r: (r["doc_id"], r["label"], r["places"]))
    grade, owner, place, times = [], [], [], []
    for k, r in enumerate(found):
        marks = sum(c for p, c in zip(r["places"], r["counts"]) if marker[p])
        grade.append(0 if r["label"] == 0 else 1 if marks <= 1 else 2 if marks <= 4 else 3)
        owner += [k] * len(r["places"])
        place += r["places"]
        times += r["counts"]
    if not grade:
        return None
    grade = np.array(grade)
    stands = np.where(grade > 0, count[1] / n1, count[0] / n0)
    value = 1 + np.log2(np.maximum(np.array(times, float), 1))
    model = Ordinal.fit(np.array(owner, np.int64), np.array(place, np.int64), value, grade, len(vocabulary), stands / stands.mean())
    return vocabulary, model


def _grade(send):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, thresholds = send.value
        model = Ordinal(weights, thresholds)
        known = dict(zip(vocabulary, weights.tolist()))
        for batch in pieces(batches):
            score = np.zeros(batch.num_rows)
            for k, text in enumerate(raw_texts(batch)):
                counts = Counter(w for w in words(text) if w in known)
                score[k] = sum(known[w] * (1 + np.log2(c)) for w, c in counts.items())
            p = model.grades(score)
            yield pa.RecordBatch.from_arrays([
                values(batch, "doc_id"), values(batch, "held_out"), pa.array(p @ np.arange(p.shape[1])),
                pa.array(p.argmax(1).astype(np.int32)), pa.array(p[:, 0] < 0.5)],
                names=["doc_id", "held_out", "severity", "grade", "toxic"])
    return run


def grade(documents: DataFrame, labels: DataFrame, hold: Column, column: str = "toxic", **fit) -> DataFrame:
    """doc_id, held_out, severity (expected grade), grade, toxic for each row; learns without ``hold``."""
    model = train(documents, labels, ~hold, column, **fit)
    given = documents.select("doc_id", hold.alias("held_out"), "text")
    if model is None:
        return given.select("doc_id", "held_out", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    vocabulary, fitted = model
    send = documents.sparkSession.sparkContext.broadcast((vocabulary, fitted.weights, fitted.thresholds))
    kind = dict(documents.dtypes)["doc_id"]
    return given.mapInArrow(_grade(send), f"doc_id {kind}, held_out boolean, severity double, grade int, toxic boolean")
