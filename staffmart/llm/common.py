"""What several operators share: table access, folds, text batches, words, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffmart.sources.tables import materialise

BATCH_BYTES = 8 << 20  # text handled at once inside a task
SEED = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(key: str, text: str) -> Column:
    """128-bit fingerprint of a row's key and text, which may be missing."""
    mark = F.when(F.col(text).isNull(), "-").otherwise(":")
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), mark, F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning; rows without a key always are."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def first_by_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """The rows of each group with the ``most`` smallest hashes of ``key``; rows should have different keys.

    Rows are counted by the first ten bits of the hash, then, in the one stretch of hashes where a group reaches ``most``, by
    the next ten; only what shares all twenty is ranked. So no group meets in one task, however large it is.
    """
    def borders(counted: DataFrame, digit: str) -> DataFrame:
        """Per group and digit: how many rows come before, and how many there are."""
        so_far = Window.partitionBy(group).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        counts = counted.groupBy(group, digit, "__base").agg(F.count(F.lit(1)).alias("__n"))
        return materialise(counts.withColumn("__before", F.col("__base") + F.coalesce(F.sum("__n").over(so_far), F.lit(0))), "borders")

    def split(dealt: DataFrame, counts: DataFrame, digit: str) -> tuple[DataFrame, DataFrame]:
        """Rows that stay, and rows at the border."""
        whole = counts.where(F.col("__before") + F.col("__n") <= most).select(group, digit)
        cut = counts.where((F.col("__before") < most) & (F.col("__before") + F.col("__n") > most)).select(
            group, digit, F.col("__before").alias("__base"))
        return dealt.join(F.broadcast(whole), [group, digit]), dealt.drop("__base").join(F.broadcast(cut), [group, digit])

    bits = F.xxhash64(key)
    dealt = rows.select("*", F.shiftrightunsigned(bits, 54).alias("__high"), F.shiftrightunsigned(bits, 44).bitwiseAND(F.lit(1023)).alias("__low"),
                        F.lit(0).cast("long").alias("__base"))
    dealt = materialise(dealt, "dealt")
    first, rest = split(dealt, borders(dealt, "__high"), "__high")
    second, tied = split(rest, borders(rest, "__low"), "__low")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(bits, key))
    tied = tied.withColumn("__rank", F.col("__base") + rank).where(F.col("__rank") <= most)
    return first.select(*rows.columns).unionByName(second.select(*rows.columns)).unionByName(tied.select(*rows.columns))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text",
           most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """Texts as UTF-8; a missing text is empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(count: int, salt: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * SEED + np.uint64(salt)) | np.uint64(1)
