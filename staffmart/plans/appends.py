"""Rows appended to the operational tables, judged by keys in hash buckets kept with each load.

Every key of ``OPERATIONAL_KEYS`` is stored with its table and column, so that one look at the buckets of the appended rows' own keys
and references tells which keys are taken and which references are there. Stored rows are not read, and the appended
ones become a piece of their table, entered together with their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.functions.text import insensitive_key
from staffmart.operators.audit import BrokenRules, audit_check, rating_in_range, require_clean
from staffmart.operators.lookup import join_found
from staffmart.plans.intake import with_audit_times
from staffmart.plans.landing import stored_schema
from staffmart.schemas import INSENSITIVE, OPERATIONAL, OPERATIONAL_KEYS, OPERATIONAL_REFERENCES
from staffmart.sources.key_index import BUCKET_ROWS, KeyIndex
from staffmart.sources.key_index import TABLE as KEYS
from staffmart.sources.tables import materialise
from staffmart.sources.versions import Load, current_load, enter, new_folder, read_pieces, write_whole

_INDEXED = "keys_of"


def _key(table: str, column: str, value: Column) -> Column:
    text = value.cast("string")
    return F.concat(F.lit(f"{table}.{column}:"), insensitive_key(text) if (table, column) in INSENSITIVE else text)


def _own_keys(table: str) -> list[str]:
    return [column for name, column in OPERATIONAL_KEYS if name == table]


def _references(table: str) -> list[tuple[str, str]]:
    return [(column, parent) for child, column, parent in OPERATIONAL_REFERENCES if child == table]


def _keys_of(table: str, rows: DataFrame) -> DataFrame:
    """One row per key value: every key column of a row is a key of its own."""
    keys = F.explode(F.array(*[_key(table, c, F.col(c)) for c in _own_keys(table)]))
    return rows.select(keys.alias("key")).where("key is not null")


def index_operational(spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS) -> Load:
    """Fill the buckets from the stored tables, once; the tables' own pieces stay as they are."""
    load = current_load(spark, root)
    if load is None:
        raise FileNotFoundError(f"no complete load under {root}")
    if _INDEXED in load.notes:
        return load
    found = None
    for table in OPERATIONAL:
        own = _keys_of(table, read_pieces(spark, root, load.of(table), stored_schema(table)))
        found = own if found is None else found.unionByName(own)
    pieces, notes = KeyIndex(spark, root, None, bucket_rows=bucket_rows).with_rows(materialise(found.distinct(), "keys"))
    enter(spark, root, new_folder(root), [*load.without(KEYS), *pieces],
          {**load.notes, **notes, _INDEXED: "operational"}, after=load.version)
    return current_load(spark, root)


def append_findings(spark: SparkSession, root: str, table: str, rows: DataFrame, load: Load | None = None,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(rule, key, row_count) of what a database would refuse in rows to be appended; a NULL key or reference is fine.

    A key may be taken by a stored row or repeated among the rows; a reference may be to nothing; a rating may be out of range.
    """
    index = KeyIndex(spark, root, load or index_operational(spark, root, bucket_rows), bucket_rows=bucket_rows)
    asked = [(f"{table}.{c} repeated", f"{table}.{c} taken", c, table, c) for c in _own_keys(table)]
    asked += [("", f"{table}.{c} not in {parent}", c, parent, c) for c, parent in _references(table)]
    uses = F.explode(F.array(*[F.struct(
        F.lit(repeated).alias("repeated"), F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value"),
        _key(owner, owned, F.col(column)).alias("key")) for repeated, rule, column, owner, owned in asked])).alias("u")
    counted = materialise(rows.select(uses).select("u.*").where("key is not null").groupBy("repeated", "rule", "key").agg(
        F.min("value").alias("value"), F.count(F.lit(1)).alias("row_count")), "uses")
    stored = index.find(counted.select("key")).withColumn("stored", F.lit(True))
    judged = join_found(counted, stored, "key")
    own = F.col("repeated") != ""
    broken = judged.where(F.when(own, F.col("stored").isNotNull()).otherwise(F.col("stored").isNull())).select(
        "rule", F.col("value").alias("key"), "row_count")
    twice = judged.where(own & (F.col("row_count") > 1)).select(F.col("repeated").alias("rule"), F.col("value").alias("key"), "row_count")
    out = broken.unionByName(twice)
    if table == "reviews":
        ratings = audit_check(rows, rating_in_range()).select(
            F.lit("reviews.rating out of range").alias("rule"), F.col("review_id").alias("key"), F.lit(1).cast("long").alias("row_count"))
        out = out.unionByName(ratings)
    return out


def append_rows(spark: SparkSession, root: str, table: str, rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Load:
    """Append rows to an operational table, or refuse them all with ``BrokenRules``. Employees get audit times."""
    load = index_operational(spark, root, bucket_rows)
    rows = materialise(rows.select(*OPERATIONAL[table].names), f"append-{table}")
    require_clean(append_findings(spark, root, table, rows, load, bucket_rows))
    stored = with_audit_times(rows) if table == "employees" else rows
    folder = new_folder(root)
    pieces, notes = KeyIndex(spark, root, load, bucket_rows=bucket_rows).with_rows(materialise(_keys_of(table, rows), "keys"))
    enter(spark, root, folder, [*load.without(KEYS), *pieces, *write_whole(stored, root, folder, table)],
          {**load.notes, **notes}, after=load.version)
    return current_load(spark, root)


__all__ = ["BrokenRules", "append_findings", "append_rows", "index_operational"]
