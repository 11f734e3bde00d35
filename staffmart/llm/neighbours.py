"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected with Gaussian weights to ``DIMENSIONS`` numbers. For a vector at distance
d the squared projected distance over d*d follows a chi-square law, so once the projected neighbours still to
come are farther than d_k * sqrt(quantile), where d_k is the distance of the k-th neighbour
found, each true neighbour has been seen with the probability of that quantile.

The upper levels of the kd-tree are split at medians of a bounded sample (``sample_rows``, chosen by a hash of the id)
and give cells of about ``cell_rows`` vectors, at most ``most_cells``; every vector is indexed. Cells that are larger,
such as one point many times, are dealt by id to parts of that size. A task builds the lower levels for its part and visits
leaves in order of projected distance until the test holds. Queries first search their own
cell, then every other cell whose box the test does not rule out.

Distances are Euclidean, in double precision, on the original vectors; ties go to the smaller
id. Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part. Those of
different length are not compared: each length is searched on its own. Rows with an id of their own count once, at their smallest
distance; rows without an id take no part. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffmart.llm.common import values
from staffmart.sources.tables import materialise

DIMENSIONS = 8  # even, for the closed form of the chi-square law
SURE = 0.99
SAMPLE_ROWS, CELL_ROWS, MOST_CELLS, LEAF = 20_000, 4096, 1 << 14, 64


def chi_square(x: float, dimensions: int = DIMENSIONS) -> float:
    """Distribution function for an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2)**i / math.factorial(i) for i in range(dimensions // 2))


def quantile(share: float, dimensions: int = DIMENSIONS) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, dimensions) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < share else (low, middle)
    return high


def weights(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(length, dimensions))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


class Cells:
    """Median splits of a sample: node k has children 2k + 1 and 2k + 2; a leaf has axis -1."""

    def __init__(self, sample: np.ndarray, cells: int):
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis = np.full(2**(depth + 1) - 1, -1, np.int32)
        self.at = np.zeros(len(self.axis))
        todo = [(0, sample, 0)]
        while todo:
            node, rows, level = todo.pop()
            if level == depth or len(rows) < 2:
                continue
            axis = int(np.argmax(rows.max(0) - rows.min(0)))
            middle = float(np.median(rows[:, axis]))
            left = rows[:, axis] <= middle
            if left.all() or not left.any():
                continue
            self.axis[node], self.at[node] = axis, middle
            todo += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]

    def of(self, rows: np.ndarray) -> np.ndarray:
        return cells_of(self.axis, self.at, rows)


def cells_of(axis: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    node = np.zeros(len(rows), np.int64)
    while True:
        inner = np.flatnonzero(axis[node] >= 0)
        if not len(inner):
            return node
        own = node[inner]
        node[inner] = 2 * own + 1 + (rows[inner, axis[own]] > at[own])


def leaves(rows: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        spread = rows[own].max(0) - rows[own].min(0)
        axis = int(np.argmax(spread))
        order = np.argpartition(rows[own, axis], len(own) // 2)
        todo += [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
    return out


class Part:
    """The kd-tree of one part of a cell."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        self.ids, self.vectors, self.projected = ids, vectors, projected
        self.leaves = leaves(projected)
        self.low = np.array([projected[own].min(0) for own in self.leaves])
        self.high = np.array([projected[own].max(0) for own in self.leaves])

    def nearest(self, query: int, vector: np.ndarray, projected: np.ndarray, k: int, bound: float,
                limit: float) -> list[tuple[float, int]]:
        """The nearest of the part that are not farther than ``bound``, as (distance, id)."""
        away = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        away = (away * away).sum(1)
        best: dict[int, float] = {}
        far, slack = bound, rounding(projected)
        for leaf in np.argsort(away, kind="stable"):
            if away[leaf] > limit * far * far + slack:
                break
            own = self.leaves[leaf]
            near = ((self.projected[own] - projected)**2).sum(1) <= limit * far * far + slack
            own = own[near & (self.ids[own] != query)]
            difference = self.vectors[own] - vector
            for d, i in zip(np.sqrt((difference * difference).sum(1)).tolist(), self.ids[own].tolist()):
                if d <= far and d < best.get(i, math.inf):
                    best[i] = d
            if len(best) >= k:
                kept = sorted((d, i) for i, d in best.items())[:k]
                best = {i: d for d, i in kept}
                far = min(far, kept[-1][0])
        return sorted((d, i) for i, d in best.items())[:k]


def rounding(projected: np.ndarray) -> float:
    """What equal vectors' squared projected distance may differ by, as products of batches round differently."""
    return 1e-9 * (1 + float(projected @ projected))


def usable(vector: str) -> Column:
    c = F.col(vector)
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return c.isNotNull() & (F.size(c) > 0) & whole & F.exists(c, lambda x: x != 0)


def _project(length: int, tree) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = weights(length)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(values(batch, "embedding"), length) @ by
            cell = cells_of(*tree.value, y) if tree is not None else np.zeros(len(y), np.int64)
            yield pa.RecordBatch.from_arrays([
                values(batch, "vec_id"), values(batch, "embedding"), pa.array(list(y), pa.list_(pa.float64())), pa.array(cell)],
                names=["vec_id", "embedding", "y", "cell"])
    return run


def _visits(send, limit: float):
    """Each query once for every part of every cell it must still search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, low, high, parts = send.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                y = np.array(values(row, "y")[0].as_py())
                bound, home = values(row, "bound")[0].as_py(), values(row, "cell")[0].as_py()
                away = np.maximum(np.maximum(low - y, y - high), 0)
                go = np.flatnonzero(((away * away).sum(1) <= limit * bound * bound + rounding(y)) & (cell != home))
                count = parts[go]
                total = int(count.sum())
                if not total:
                    continue
                part = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                again = pa.array(np.zeros(total, np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(cell[go], count)), pa.array(part), values(row, "vec_id").take(again),
                    values(row, "embedding").take(again), values(row, "y").take(again), values(row, "bound").take(again)],
                    names=["cell", "part", "vec_id", "embedding", "y", "bound"])
    return run


def _search(length: int, k: int, limit: float):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and asked.num_rows:
            rows, asked = rows.combine_chunks(), asked.combine_chunks()
            part = Part(rows.column("vec_id").to_numpy(), matrix(rows.column("embedding").combine_chunks(), length),
                        matrix(rows.column("y").combine_chunks(), DIMENSIONS))
            for query, vector, y, bound in zip(
                    asked.column("vec_id").to_pylist(), matrix(asked.column("embedding").combine_chunks(), length),
                    matrix(asked.column("y").combine_chunks(), DIMENSIONS), asked.column("bound").to_pylist()):
                for d, i in part.nearest(query, vector, y, k, bound, limit):
                    out["query_id"].append(query)
                    out["vec_id"].append(i)
                    out["score"].append(d)
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
    return run


_FOUND = "query_id long, vec_id long, score double"


def _first(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, asked: Column, k: int = 10, sure: float = SURE, cell_rows: int = CELL_ROWS,
            sample_rows: int = SAMPLE_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` nearest rows for each row with ``asked``."""
    spark = vectors.sparkSession
    given = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")
        if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = given.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    out = None
    for row in sizes:  # as many as there are different lengths
        own = given.where(F.size("embedding") == row["size"])
        found = _nearest(own, row["size"], row["n"], asked, k, sure, cell_rows, sample_rows, most_cells)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(sizes) > 1:  # an id may have vectors of several lengths
        out = _first(out.select("query_id", "vec_id", "score"), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(given: DataFrame, length: int, count: int, asked: Column, k: int, sure: float, cell_rows: int, sample_rows: int,
             most_cells: int) -> DataFrame:
    """The nearest among vectors of one length."""
    spark = given.sparkSession
    kind = dict(given.dtypes)["embedding"]
    schema = f"vec_id long, embedding {kind}, y array<double>, cell long"
    chosen = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).mapInArrow(_project(length, None), schema)
    sample = np.array([r["y"] for r in chosen.select("y").collect()])
    tree = Cells(sample, min(most_cells, -(-count // cell_rows)))
    send = spark.sparkContext.broadcast((tree.axis, tree.at))
    indexed = materialise(given.mapInArrow(_project(length, send), schema), "projected")
    boxes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[
        f(F.col("y")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)])
    boxes = boxes.withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("long"))
    known = sorted(boxes.collect(), key=lambda r: r["cell"])  # at most most_cells rows
    corners = [np.array([[r[f"{name}{i}"] for i in range(DIMENSIONS)] for r in known]) for name in ("low", "high")]
    shape = spark.sparkContext.broadcast((np.array([r["cell"] for r in known]), *corners, np.array([r["parts"] for r in known])))
    parts = F.broadcast(spark.createDataFrame([(r["cell"], r["parts"]) for r in known], "cell long, parts long"))
    dealt = indexed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    dealt = dealt.select("cell", "part", "vec_id", "embedding", "y")
    limit = quantile(sure)

    def search(queries: DataFrame) -> DataFrame:
        queries = queries.toDF(*queries.columns)  # columns of its own, as both sides come from one table
        return dealt.groupBy("cell", "part").cogroup(queries.groupBy("cell", "part")).applyInArrow(
            _search(length, k, limit), _FOUND)

    queries = indexed.where(asked)
    home = queries.join(parts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "vec_id", "embedding", "y",
        F.lit(math.inf).alias("bound"))
    first = materialise(_first(search(home), k), "nearest-at-home")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = queries.join(bounds, "vec_id", "left").select(
        "cell", "vec_id", "embedding", "y", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    visits = rest.mapInArrow(_visits(shape, limit), f"cell long, part long, vec_id long, embedding {kind}, y array<double>, bound double")
    return _first(search(visits).unionAll(first.select("query_id", "vec_id", "score")), k)
