"""Upserts by natural key on tables without MERGE: join, rewrite, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.operators.ordering import with_position


def next_key(existing: DataFrame, key: str) -> int:
    """The number after the highest surrogate key in use."""
    return (existing.agg(F.max(key).alias("top")).first().top or 0) + 1


def upsert(existing: DataFrame, incoming: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """Known natural keys keep their surrogate key and take every other incoming column.

    New natural keys get the next surrogate keys in key order. Incoming rows must be unique
    by natural key; ``audit_unique`` finds the ones that are not.
    """
    values = [c for c in existing.columns if c not in (natural, surrogate)]
    changed = incoming.select(natural, *[F.col(c).alias(f"_{c}") for c in values],
                              F.lit(True).alias("_given"))
    kept = existing.join(changed, natural, "left").select(
        surrogate, natural,
        *[F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])
    added = incoming.select(natural, *values).join(existing, natural, "left_anti")
    numbered = with_position(added, surrogate, [natural], next_key(existing, surrogate))
    return kept.unionByName(numbered).select(*existing.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing``; a stored row always wins."""
    return incoming.join(existing, key, "left_anti").dropDuplicates([key])
