"""Quality classifier: linear support vectors on indicators scaled by class log-count ratios.

A text becomes a set of hashed indicators (2**18): words, pairs of words, word shapes, and pairs
and triples of shapes. Each indicator is scaled by the logarithm of its share among good texts over its
share among bad ones, the vector is brought to length one, and a hinge-loss model is fitted by
dual coordinate descent. A logistic curve, fitted on rows the model has not seen and weighted to the classes'
true shares, turns margins into scores.

Learning uses a bounded sample, chosen by a hash of the id, half from each class where there
are enough: ``fit_rows`` rows for the ratios, of these ``vector_rows`` for the hinge loss and as many
for the curve. Only indicators of the text enter a score.

Null and empty texts have no indicators and get the score of the bias. Without labels of both
classes every score is the share of good rows, or 0.5 if there are none. An id with several labels
has the larger one. Rows that repeat give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import first_by_hash, mix, odd_numbers, pieces, raw_texts, values
from staffmart.sources.tables import materialise

BITS = 18
FIT_ROWS, VECTOR_ROWS = 20_000, 3_000
PENALTY, ROUNDS = 1.0, 15
GOOD = 0.7
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
               for b in range(256))
_MEMO = 400_000


class Indicators:
    """Distinct hashed indicators of texts; remembers the hashes of words it has met."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.word: list[int] = []
        self.shape: list[int] = []
        self.runs = re.compile(rb"(.)\1+", re.S).sub

    def _tokens(self, text: bytes) -> list[int]:
        out = []
        number = self.number
        for w in text.split():
            k = number.get(w)
            if k is None:
                k = number[w] = len(number)
                self.word.append(zlib.crc32(w.lower()))
                self.shape.append(zlib.crc32(self.runs(rb"\1", w.translate(_SHAPE))))
            out.append(k)
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(indicators of all texts, offsets)."""
        if len(self.number) > _MEMO:
            self.__init__()
        tokens = [self._tokens(t) for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = np.fromiter((k for t in tokens for k in t), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        word = np.array(self.word, np.uint64)[flat] if len(flat) else np.empty(0, np.uint64)
        shape = np.array(self.shape, np.uint64)[flat] if len(flat) else np.empty(0, np.uint64)
        factors = odd_numbers(3, 23)
        keys = []
        for salt, source, length in ((1, word, 1), (2, word, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
            n = max(0, len(flat) - length + 1)
            h = np.full(n, salt, np.uint64)
            for k in range(length):
                h += source[k:k + n] * factors[k]
            inside = owner[:n] == owner[length - 1:length - 1 + n]
            feature = (mix(h[inside] * factors[2] + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append((owner[:n][inside] << BITS) | feature)
        keys = np.unique(np.concatenate(keys))
        return keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(len(texts) + 1))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maker = Indicators()
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in pieces(batches):
        features, offsets = maker.of(raw_texts(batch))
        label = np.repeat(values(batch, "label").to_numpy(), np.diff(offsets))
        for c in (0, 1):
            total[c] += np.bincount(features[label == c], minlength=1 << BITS)
    seen = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])],
                                     names=["feature", "bad", "good"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maker = Indicators()
    for batch in pieces(batches):
        features, offsets = maker.of(raw_texts(batch))
        yield pa.RecordBatch.from_arrays([
            values(batch, "label"), values(batch, "place"),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(features.astype(np.int32)))],
            names=["label", "place", "features"])


def hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: np.ndarray, rounds: int = ROUNDS,
          seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent; ``y`` is 1 or -1, ``penalty`` bounds each dual value."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(len(scale)), 0.0
    dual = np.zeros(len(rows))
    values_ = [unit(scale[r]) for r in rows]
    square = np.array([v @ v + 1 for v in values_])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (weights[rows[i]] @ values_[i] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), penalty[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                weights[rows[i]] += step * values_[i]
                bias += step
                dual[i] = new
    return weights, bias


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt(v @ v)
    return v / length if length else v


def logistic(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps with a little damping."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        d, h = weight * (p - good), weight * p * (1 - p)
        gradient = np.array([d @ margin + 1e-3 * a, d.sum()])
        hessian = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def sample(documents: DataFrame, labels: DataFrame, column: str, learn: Column, rows: int) -> tuple[DataFrame, dict]:
    """Sampled documents with ``label``, at most ``rows`` of them, and the number of labelled ids of each class.

    Only ids and labels are chosen from; the chosen ids, at most ``rows``, go to the documents. An id that several
    documents share counts once, with the smallest of its texts.
    """
    known = labels.where(learn & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(column).cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = first_by_hash(known, "label", "doc_id", rows // 2)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialise(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample"), count


def train(documents: DataFrame, labels: DataFrame, learn: Column, column: str = "quality", fit_rows: int = FIT_ROWS,
          vector_rows: int = VECTOR_ROWS) -> dict:
    rows, count = sample(documents, labels, column, learn, fit_rows)
    share = count.get(1, 0) / max(1, sum(count.values())) if count else 0.5
    flat = {"weights": np.zeros(1 << BITS), "scale": np.zeros(1 << BITS), "bias": 0.0, "curve": None, "share": share}
    if len(count) < 2:
        return flat
    totals = np.ones((2, 1 << BITS))
    sums = rows.select("label", "text").mapInArrow(_class_counts, "feature long, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    for r in sums.toLocalIterator():  # at most 2**18 rows
        totals[:, r["feature"]] += r["bad"], r["good"]
    totals /= totals.sum(1, keepdims=True)
    scale = np.log(totals[1] / totals[0])
    fewer = first_by_hash(rows.select("label", "doc_id"), "label", "doc_id", vector_rows).select("doc_id")
    vectors = rows.join(F.broadcast(fewer), "doc_id").select("label", F.xxhash64("doc_id").alias("place"), "text").mapInArrow(
        _vectors, "label int, place long, features array<int>").collect()
    vectors = sorted((r["place"], r["label"], r["features"]) for r in vectors)
    if not vectors:
        return flat
    y = np.array([v[1] for v in vectors])
    sets = [np.array(v[2], np.int64) for v in vectors]
    sizes = np.bincount(y, minlength=2)
    weight = np.array([count[c] for c in y]) / sizes[y]  # rows each sampled row stands for
    fit = np.arange(len(y)) % 2 == 0
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit[:] = True
    penalty = PENALTY * (sizes.sum() / 2 / sizes[y])
    at = np.flatnonzero(fit)
    weights, bias = hinge([sets[i] for i in at], np.where(y[at] == 1, 1, -1), scale, penalty[at])
    rest = np.flatnonzero(~fit) if not fit.all() else at
    margin = np.array([weights[sets[i]] @ unit(scale[sets[i]]) + bias for i in rest])
    curve = logistic(margin, y[rest].astype(float), weight[rest] / weight[rest].mean())
    return {"weights": weights, "scale": scale, "bias": bias, "curve": curve, "share": share}


def scores(model: dict, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if model["curve"] is None:
        return np.full(n, model["share"])
    owner = np.repeat(np.arange(n), np.diff(offsets))
    scale = model["scale"][features]
    dot = np.bincount(owner, model["weights"][features] * scale, n)
    length = np.sqrt(np.bincount(owner, scale * scale, n))
    margin = np.where(length > 0, dot / np.maximum(length, 1e-300), 0.0) + model["bias"]
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * margin + b, -700, 700)))


def _score(send):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Indicators()
        for batch in pieces(batches):
            score = scores(send.value, *maker.of(raw_texts(batch)))
            yield pa.RecordBatch.from_arrays([
                values(batch, "doc_id"), values(batch, "held_out"), pa.array(score),
                pa.array((score >= GOOD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return run


def classify(documents: DataFrame, labels: DataFrame, hold: Column, column: str = "quality", **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learns from labelled rows without ``hold``."""
    model = train(documents, labels, ~hold, column, **fit)
    send = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", hold.alias("held_out"), "text").mapInArrow(
        _score(send), f"doc_id {kind}, held_out boolean, score double, predicted int")
