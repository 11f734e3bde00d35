"""Submitted rows as a stream of files: judged, then appended or put in quarantine.

What was taken in before is known from keys in hash buckets, of which a micro-batch reads and extends only its own, so
its work does not grow with what came before. Each micro-batch writes its own folders and is done with one entry in the log
of the keys; a repeated one overwrites its folders if it was not, and does nothing if it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from staffmart.functions.text import insensitive_key, strip
from staffmart.plans.intake import Intake, once
from staffmart.sources.key_index import BUCKET_ROWS, KeyIndex
from staffmart.sources.tables import materialise, write_parquet
from staffmart.sources.versions import current_load, drop_entry, enter, new_folder

Judge = Callable[[DataFrame, DataFrame | None], Intake]
KEPT_ENTRIES = 20


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def intake_stream(submissions: DataFrame, root: str, judge: Judge, checkpoint: str, unique: Sequence[str] = (),
                  insensitive: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Judge all files that are there, write ``root``/accepted and ``root``/quarantine, stop.

    A submission id that came in an earlier micro-batch adds nothing; of one that comes several times in a
    micro-batch the smallest row counts, and rows without one are all judged, as in a batch. ``judge`` gets the new submissions and the
    rows accepted before that share a value of a ``unique`` column with them (None without such columns).
    Values of ``insensitive`` columns are stored and returned without case and accents.
    """
    def value(column: str) -> Column:
        bare = strip(F.col(column))
        return insensitive_key(bare) if column in insensitive else bare

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        load = current_load(spark, root)
        if load is not None and int(load.notes["batch"]) >= batch_id:
            return
        index = KeyIndex(spark, root, load, bucket_rows=bucket_rows)
        first = materialise(once(batch).withColumn("_key", _key("submission", F.col("submission_id"))), "submitted")
        seen = index.find(first.select(F.col("_key").alias("key"))).withColumnRenamed("key", "_key")
        # Written once, so that all outputs judge the same rows.
        new = materialise(first.join(seen, "_key", "left_anti").select(*batch.columns), "batch")
        stored = None
        if unique:
            asked = [new.select(_key(c, value(c)).alias("key")) for c in unique]
            found = index.find(_union(asked))
            stored = materialise(found.select(*[
                F.when(F.col("key").startswith(f"{c}:"), F.substring(F.col("key"), F.lit(len(c) + 2), F.length("key"))).alias(c)
                for c in unique]), "stored")
        result = judge(new, stored)
        written = {"accepted": result.accepted, "quarantine": result.quarantine}
        for name, rows in written.items():
            write_parquet(rows, f"{root}/{name}/batch={batch_id}")
        accepted = spark.read.schema(result.accepted.schema).parquet(f"{root}/accepted/batch={batch_id}")
        keys = [new.select(_key("submission", F.col("submission_id")).alias("key"))]
        keys += [accepted.select(_key(c, value(c)).alias("key")) for c in unique]
        pieces, notes = index.with_rows(materialise(_union(keys).where("key is not null"), "keys"))
        done = enter(spark, root, new_folder(root), pieces, {**notes, "batch": batch_id}, after=load.version if load else 0)
        drop_entry(spark, root, done - KEPT_ENTRIES)

    return (submissions.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
