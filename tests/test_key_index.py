"""Keys in hash buckets."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.sources import key_index
from staffmart.sources.key_index import TABLE, KeyIndex, bucket_of, split_buckets
from staffmart.sources.tables import materialise
from staffmart.sources.versions import current_load, enter, new_folder

VALUES = T.StructType([T.StructField("n", T.LongType()), T.StructField("word", T.StringType())])


def frame(spark, rows):
    return materialise(spark.createDataFrame(rows, "key string, n long, word string"), "keys")


def add(spark, root, rows, bucket_rows, added=None, values=VALUES):
    load = current_load(spark, root)
    pieces, notes = KeyIndex(spark, root, load, values, bucket_rows).with_rows(frame(spark, rows), added)
    enter(spark, root, new_folder(root), pieces, notes, after=load.version if load else 0)
    return current_load(spark, root)


def found(spark, root, keys, values=VALUES):
    index = KeyIndex(spark, root, current_load(spark, root), values)
    return {r.key: tuple(r)[1:] for r in index.find(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}


def test_buckets_split_one_by_one():
    """Growing by one bucket moves only rows of the bucket that is split."""
    for old in range(1, 40):
        for new in range(old, 45):
            assert all(0 <= b < old for b in split_buckets(old, new))
            assert len(split_buckets(old, old + 1)) == 1


def test_addresses(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    for old, new in ((1, 2), (3, 4), (4, 7), (5, 23), (8, 8)):
        rows = df.select(bucket_of(F.col("key"), old).alias("a"), bucket_of(F.col("key"), new).alias("b")).collect()
        assert all(0 <= r.a < old and 0 <= r.b < new for r in rows)
        assert {r.a for r in rows if r.a != r.b} <= split_buckets(old, new)
        assert len({r.b for r in rows}) == new


@pytest.mark.parametrize("bucket_rows", [5, 40, 10_000])
def test_equals_a_dictionary(spark, tmp_path, bucket_rows, monkeypatch):
    monkeypatch.setattr(key_index, "MOST_PIECES", 3)
    rng, want, root = random.Random(3), {}, str(tmp_path / "index")
    for step in range(6):
        batch = {f"k{rng.randint(0, 150)}": (step, f"w{rng.randint(0, 9)}") for _ in range(rng.choice([0, 1, 30, 60]))}
        load = add(spark, root, [(k, *v) for k, v in batch.items()], bucket_rows, len(set(batch) - set(want)))
        want |= batch
        assert int(load.notes["keys_rows"]) == len(want)
        assert all(len([p for p in load.of(TABLE) if p.part == part]) <= 4 for part in {p.part for p in load.of(TABLE)})
    asked = [f"k{n}" for n in range(170)]
    assert found(spark, root, [*asked, None, "k1"]) == {k: want[k] for k in asked if k in want}
    assert found(spark, root, []) == {}


def test_a_lookup_reads_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "index")
    load = add(spark, root, [(f"k{n}", n, "w") for n in range(1000)], 10)
    index = KeyIndex(spark, root, load, VALUES, 10)
    asked = spark.createDataFrame([("k1",), ("k2",), ("none",)], "key string")
    touched = index.touched(asked)
    assert index.count == 100 and len(touched) <= 3
    read = {pathlib.Path(f).parent.parent.name for f in index._read(touched).inputFiles()}
    assert read <= {f"bucket={b}" for b in touched}


def test_a_batch_writes_what_it_adds(spark, tmp_path):
    """Pieces written by one key each do not grow with what is stored."""
    root = str(tmp_path / "index")
    written = []
    for n in range(0, 900, 300):
        add(spark, root, [(f"k{m}", m, "w") for m in range(n, n + 300)], 10)
        before = set(current_load(spark, root).of(TABLE))
        add(spark, root, [(f"one{n}", 1, "w")], 10)
        written.append(len(set(current_load(spark, root).of(TABLE)) - before))
    assert max(written) <= 4
