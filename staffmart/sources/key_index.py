"""Stored keys in hash buckets: a lookup reads the buckets of the keys asked for and nothing else.

Linear hashing: with ``n`` buckets a key belongs to the bucket of its hash modulo the power of two above ``n``, or, if that one does
not exist yet, modulo the power below. A batch of new keys adds as many buckets as its share of ``bucket_rows``,
each by splitting one older bucket, so buckets keep their size, and the work of a batch follows the batch and not what
was stored before. New keys are appended to their bucket as a piece; a bucket of many pieces is
written anew when it is touched. The buckets are pieces of a load (``staffmart.sources.versions``), so keys become visible with the
rows they belong to. A key may have values; the newest ones count.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.sources.versions import Load, Piece, read_pieces, write_parts

TABLE = "keys"
BUCKET_ROWS = 100_000
MOST_PIECES = 8
_BUCKETS, _ROWS = "keys_buckets", "keys_rows"


def bucket_of(key: Column, count: int) -> Column:
    """Bucket of a key among ``count``."""
    below = 1 << (count.bit_length() - 1)
    wide = F.pmod(F.xxhash64(key), F.lit(2 * below))
    return F.when(wide < count, wide).otherwise(F.pmod(wide, F.lit(below))).cast("long")


def split_buckets(old: int, new: int) -> set[int]:
    """The buckets among ``old`` that lose rows when there are ``new``."""
    out = set()
    for bucket in range(old, new):
        while bucket >= old:
            bucket -= 1 << (bucket.bit_length() - 1)
        out.add(bucket)
    return out


class KeyIndex:
    """The keys of a load (or none yet); ``values`` are the fields stored with each."""

    def __init__(self, spark: SparkSession, root: str, load: Load | None, values: T.StructType | None = None,
                 bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.bucket_rows = spark, root, bucket_rows
        self.values = [f.name for f in values or []]
        fields = [T.StructField("key", T.StringType()), *(values or []), T.StructField("seq", T.LongType()),
                  T.StructField("bucket", T.LongType())]
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        self.version = load.version if load else 0
        self.count = int(load.notes.get(_BUCKETS, 1)) if load else 1
        self.rows = int(load.notes.get(_ROWS, 0)) if load else 0
        self.pieces: dict[int, list[Piece]] = defaultdict(list)
        for piece in load.of(TABLE) if load else []:
            self.pieces[int(piece.part)].append(piece)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the given keys; at most as many as there are."""
        found = keys.where("key is not null").select(bucket_of(F.col("key"), self.count).alias("b")).distinct().collect()
        return sorted(r.b for r in found)

    def _read(self, buckets: list[int]) -> DataFrame:
        return read_pieces(self.spark, self.root, [p for b in buckets for p in self.pieces.get(b, ())], self.schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.values:
            return rows.select("key").distinct()
        newest = F.max_by(F.struct(*self.values), "seq").alias("newest")
        return rows.groupBy("key").agg(newest).select("key", "newest.*")

    def find(self, keys: DataFrame) -> DataFrame:
        """The given keys (column ``key``) that are stored, once each, with their values."""
        keys = keys.select("key").where("key is not null").distinct()
        return self._newest(self._read(self.touched(keys)).join(keys, "key", "left_semi"))

    def with_rows(self, rows: DataFrame, added: int | None = None) -> tuple[list[Piece], dict[str, int]]:
        """All pieces of the index and its notes, after rows with different keys came in.

        ``rows`` should be a written table. ``added`` is how many of the keys are new (all by default).
        """
        rows = rows.select("key", *self.values)
        added = rows.count() if added is None else added
        total = self.rows + added
        count = max(self.count, -(-total // self.bucket_rows))
        splits = split_buckets(self.count, count)
        crowded = {b for b in self.touched(rows) if len(self.pieces.get(b, ())) >= MOST_PIECES}
        anew = sorted(splits | crowded)
        kept = [p for b, own in self.pieces.items() if b not in splits | crowded for p in own]
        out = rows.withColumn("seq", F.lit(self.version + 1).cast("long"))
        if any(self.pieces.get(b) for b in anew):
            stored = self._newest(self._read(anew)).withColumn("seq", F.lit(self.version).cast("long"))
            # Rows of other buckets pass through; a key has one row here and one stored at most.
            both = out.unionByName(stored)
            out = both.groupBy("key").agg(F.max("seq").alias("seq"), *(
                [F.max_by(F.struct(*self.values), "seq").alias("newest")] if self.values else []))
            out = out.select("key", *([f"newest.{v}" for v in self.values]), "seq")
        placed = out.select("key", *self.values, "seq", bucket_of(F.col("key"), count).alias("bucket")).repartition("bucket")
        return kept + write_parts(placed, self.root, TABLE, "bucket"), {_BUCKETS: count, _ROWS: total}
