"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.sources.tables import materialise


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each ``u`` and the smallest of itself and its neighbours; hubs are summed up before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller neighbour that has one itself."""
    ends = edges.select(F.col("b").alias("u"), F.col("a").alias("low")).unionAll(
        edges.select(F.col("a").alias("u"), F.lit(None).alias("low"))).groupBy("u").agg(
        F.min("low").alias("first"), F.max("low").alias("last"), F.count(F.lit(1)).alias("seen"), F.count("low").alias("lower"))
    return not ends.where((F.col("first") != F.col("last")) | ((F.col("lower") > 0) & (F.col("seen") > F.col("lower")))).isEmpty()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the pairs (a, b); the root is the smallest node of a component.

    Every round ties each node to the smallest node it sees, first among its larger
    neighbours, then among its smaller ones; each round is written, so a lost executor costs
    one round at most. It ends when all nodes hang on their root, after about log2 of the
    longest path rounds.
    """
    ordered = pairs.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(ordered, "edges")
    while _unsettled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = (both.join(_smallest(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = materialise(large, "large-stars")
        small = large.join(_smallest(large), "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialise(small.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), "edges")
    roots = edges.select("a").distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
