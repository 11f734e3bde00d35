"""Joins to a table with one row per key when one key may hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from staffmart.sources.tables import materialise


def join_found(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` to ``found``, which is written to the shared folder first.

    Adaptive execution splits a hot key only where both sides come straight from a shuffle.
    The result of an aggregation or a join on the same key does not: Spark keeps its
    partitioning and the hot key would stay in one task. A written table does, and its true
    size decides whether it is broadcast.
    """
    return rows.join(materialise(found, "found"), key, "left")


def known_keys(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The keys used in ``rows`` that exist in ``parent``, once each.

    Reduced on the side of the rows, so the work follows the rows and not the parent.
    """
    return rows.select(key).distinct().join(parent.select(key), key, "left_semi")
