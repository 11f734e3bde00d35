"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed five-word shingles; equal sets are copies and are joined once.
In each run a set picks about 1/level of its shingles on average, by a hash threshold of
1 / (level * its size), so two similar sets pick at least one common shingle with probability
1 - 1/e or more. The sets that picked the same shingle form a bucket. Buckets up to ``leaf``
sets are compared by brute force. Larger ones are split again by shingles sampled the same way,
unless their sets are alike on average or the depth is reached; those are compared in blocks
of bounded size, every pair of blocks in one task. The number of runs follows from the target
recall.

Brute force inside buckets compares 64 one-byte minhashes and yields candidate groups; all
sets of a candidate group are then compared exactly, block by block, on their whole shingle
sets. What leaves the tasks are counts and stars, never all pairs of a group.

Words are lower-cased (A-Z) runs without white space. A text of one to four words is one shingle.
Texts without words (null, empty, white space) are like nothing, not even each other. Rows
that repeat, with or without an id, are copies. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import mix, odd_numbers, pieces, raw_texts, row_key, values
from staffmart.llm.components import components
from staffmart.sources.tables import materialise

WORDS = 5
LEVEL = 0.8
RECALL = 0.9995  # of a pair exactly at the level that is split once more
LEAF = 8192
DEPTH = 6
DENSE = 0.4  # mean similarity above which splitting does not help
SKETCH, SKETCH_NEED = 64, 37  # a pair at level 0.8 has fewer equal bytes once in 200,000 times
BLOCK = 256
SENT_IDS = 200_000  # up to so many ids are sent to the documents; more are joined by a shuffle
_FULL = float(2**64)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the level meets below a twice split bucket with this probability."""
    once = 1 - math.exp(-1)
    twice = 1 - math.exp(-once)
    return math.ceil(math.log(1 - recall) / math.log(1 - twice))


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    factors = odd_numbers(size, 5)
    digest = xxhash.xxh3_64_intdigest
    sets = []
    for text in texts:
        own = text.lower().split()
        hashes = np.zeros(max(len(own), size), np.uint64)
        hashes[:len(own)] = np.fromiter(map(digest, own), np.uint64, len(own))
        n = len(hashes) - size + 1 if own else 0
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += hashes[k:k + n] * factors[k]
        sets.append(np.unique(mix(total)))
    return sets


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def thresholds(sizes: np.ndarray, level: float) -> np.ndarray:
    """Hash values under which a set of this size picks a shingle."""
    share = np.minimum(1.0, 1.0 / (level * np.maximum(sizes, 1)))
    return np.minimum(share * _FULL, _FULL - 4096).astype(np.uint64)


def _describe(level: float, runs: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, salts = odd_numbers(runs, 11), odd_numbers(runs, 12)
        rows = odd_numbers(SKETCH, 13)
        for batch in pieces(batches):
            sets = shingle_sets(raw_texts(batch))
            sizes = np.array([len(s) for s in sets], np.int64)
            filled = np.flatnonzero(sizes)
            flat = np.concatenate(sets) if len(filled) else np.empty(0, np.uint64)
            sketch = np.zeros((len(sets), SKETCH), np.uint8)
            if len(filled):
                starts = np.cumsum(sizes[filled]) - sizes[filled]
                for k in range(SKETCH):
                    lowest = np.minimum.reduceat(flat * rows[k], starts)
                    sketch[filled, k] = (mix(lowest) & np.uint64(255)).astype(np.uint8)
            owner = np.repeat(np.arange(len(sets)), sizes)
            limit = np.repeat(thresholds(sizes, level), sizes)
            who, paths = [], []
            for r in range(runs):
                spread = (flat ^ salts[r]) * factors[r]
                at = np.flatnonzero((spread ^ (spread >> np.uint64(32))) * factors[r] < limit)
                who.append(owner[at])
                paths.append(mix(flat[at] + salts[r]))
            who, paths = np.concatenate(who), np.concatenate(paths)
            order = np.argsort(who, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(sets)))])
            yield pa.RecordBatch.from_arrays([
                *(values(batch, c) for c in keep),
                pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(sizes.astype(np.int32)),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(paths[order].view(np.int64))),
            ], names=[*keep, "fp", "size", "sketch", "paths"])
    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_sets(raw_texts(batch))
        yield pa.RecordBatch.from_arrays([
            pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
            pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the documents whose ids are in ``wanted`` (rep), a written table; each fp once.

    Sets that are not wanted come along where several texts share an id.
    """
    ids = wanted.select(F.col("rep").alias("__rep"))
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    texts = documents.join(ids, documents["doc_id"].eqNullSafe(ids["__rep"]), "left_semi")
    own = texts.select("text").mapInArrow(_whole_sets, "fp binary, shingles binary").where("fp is not null")
    return own.groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables that hold whole groups of rows sorted by key, and pieces of groups with more than ``most`` rows.

    The second value tells the latter, of which no more than that and a batch is kept here.
    """
    rest, passing = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        rest = None
        keys = rows.column(key).to_numpy()
        if passing is not None:
            end = int(np.searchsorted(keys, passing, "right"))
            if end:
                yield rows.slice(0, end), True
            if end == len(keys):
                continue
            rows, keys, passing = rows.slice(end), keys[end:], None
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield rows.slice(0, last), False
        if most is not None and len(keys) - last > most:
            yield rows.slice(last), True
            passing = keys[-1]
        else:
            rest = rows.slice(last)
    if rest is not None:
        yield rest, False


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(level: float, leaf: int):
    """Stars of the sets in a bucket whose sketches agree, around the first of them, as (a, b).

    Rows come by path and fp. Those of buckets with more than ``leaf`` sets are handed on, without b.
    """
    def handed_on(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).combine_chunks() for c in ("fp", "path", "size", "sketch")]
        return pa.RecordBatch.from_arrays([columns[0], pa.nulls(rows.num_rows, pa.binary()), *columns[1:]],
                                          names=["a", "b", "path", "size", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in _whole_groups(batches, "path", leaf):
            if large:
                yield handed_on(rows)
                continue
            path = rows.column("path").to_numpy()
            _, which, count = np.unique(path, return_inverse=True, return_counts=True)
            if count.max() > leaf:
                yield handed_on(rows.filter(pa.array(count[which] > leaf)))
            several = (count[which] > 1) & (count[which] <= leaf)
            if not several.any():
                continue
            rows, path = rows.filter(pa.array(several)), path[several]
            sketch = _fixed(rows.column("sketch"), SKETCH)
            size = rows.column("size").to_numpy().astype(np.float64)
            fps = rows.column("fp").to_pylist()
            root = np.arange(len(path))
            at = np.arange(len(path))
            step = 0
            while len(at):
                step += 1
                at = at[at + step < len(path)]
                at = at[path[at] == path[at + step]]
                a, b = at, at + step
                ratio = np.minimum(size[a], size[b]) >= level * np.maximum(size[a], size[b])
                new = ratio & (root[a] != root[b])
                a, b = a[new], b[new]
                near = (sketch[a] == sketch[b]).sum(1) >= SKETCH_NEED
                a, b = a[near], b[near]
                while len(a) and (root[a] != root[b]).any():
                    low = np.minimum(root[a], root[b])
                    np.minimum.at(root, root[a], low)
                    np.minimum.at(root, root[b], low)
                    while (root != root[root]).any():
                        root = root[root]
            tied = np.flatnonzero(root != np.arange(len(path)))
            yield pa.RecordBatch.from_arrays([
                pa.array([fps[i] for i in root[tied]], pa.binary()), pa.array([fps[i] for i in tied], pa.binary()),
                pa.nulls(len(tied), pa.int64()), pa.nulls(len(tied), pa.int32()), pa.nulls(len(tied), pa.binary())],
                names=["a", "b", "path", "size", "sketch"])
    return run


def _children(level: float):
    """The next paths of each set below its large buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, salt = odd_numbers(2, 17)
        for batch in batches:
            out = {"path": [], "fp": [], "size": [], "sketch": []}
            for fp, size, sketch, paths, raw in zip(*(values(batch, c).to_pylist() for c in (
                    "fp", "size", "sketch", "paths", "shingles"))):
                shingles = np.frombuffer(raw, np.uint64)
                limit = thresholds(np.array([size]), level)[0]
                paths = np.array(paths, np.int64).view(np.uint64)
                for path, next_ in zip(paths, paths * salt):
                    picked = shingles[mix((shingles ^ path) * factor) < limit]
                    out["path"].append(mix(picked + next_).view(np.int64))
                    for name, value in (("fp", fp), ("size", size), ("sketch", sketch)):
                        out[name].extend([value] * len(picked))
            path = np.concatenate(out["path"]) if out["path"] else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(out["fp"], pa.binary()),
                                              pa.array(out["size"], pa.int32()), pa.array(out["sketch"], pa.binary())],
                                             names=list(out))
    return run


_SET = "fp binary, size int, sketch binary"
_ROWS = "path long, " + _SET


def _brute_force(rows: DataFrame, level: float, leaf: int) -> DataFrame:
    """Stars (a, b), and the members of larger buckets as (a, null, path, size, sketch); one shuffle, written."""
    grouped = rows.select("path", "fp", "size", "sketch").repartition(F.col("path")).sortWithinPartitions("path", "fp")
    return materialise(grouped.mapInArrow(_alike(level, leaf), "a binary, b binary, path long, size int, sketch binary"), "bucket-pairs")


def _mean_similarity(members: DataFrame) -> DataFrame:
    """(path, alike): mean share of equal bytes over all pairs of a bucket, from byte counts."""
    byte = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring("sketch", i + 1, 1).alias("byte"))
                               for i in range(0, SKETCH, SKETCH // 8)])).alias("s")
    seen = members.select("path", "n", byte).groupBy("path", "n", "s").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return seen.groupBy("path").agg((F.sum(F.col("c") * F.col("c") / F.col("n") / F.col("n")) / 8).alias("alike"))


def _block_pairs(rows: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """Rows of a group of ``count`` members, once for each pair of blocks they take part in.

    Adds ``own`` (a row's block), ``i`` and ``j`` (the pair); a block has about ``most`` members.
    """
    blocks = F.ceil(F.col(count) / F.lit(most)).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn(
        key, F.xxhash64(key, "i", "j")).drop("blocks", "other")


def candidate_pairs(documents: DataFrame, sets: DataFrame, level: float, runs: int, leaf: int, depth: int) -> DataFrame:
    """Stars of sets that met in a bucket and look alike; all runs, split to the leaves."""
    rows = sets.select(F.explode("paths").alias("path"), "fp", "size", "sketch")
    found = None
    hot = None
    for at in range(1, depth + 1):
        met = _brute_force(rows, level, leaf)
        pairs = met.where("b is not null").select("a", "b")
        found = pairs if found is None else found.unionAll(pairs)
        large = met.where("b is null").select("path", F.col("a").alias("fp"), "size", "sketch")
        if large.isEmpty():
            break
        big = materialise(large.join(large.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path"), "large-buckets")
        dense = _mean_similarity(big).where((F.col("alike") >= DENSE) | F.lit(at == depth)).select("path")
        dense = materialise(dense, "dense-buckets")
        whole = _block_pairs(big.join(dense, "path", "left_semi"), "path", "n", leaf // 2)
        found = found.unionAll(_brute_force(whole, level, 2**31).select("a", "b"))
        split = big.join(dense, "path", "left_anti")
        if split.isEmpty():
            break
        if hot is None:
            wanted = materialise(sets.join(split.select("fp"), "fp", "left_semi").select("rep"), "wanted")
            hot = materialise(sets_of(documents, wanted), "hot-sets")
        own = split.groupBy("fp").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"),
                                      F.collect_list("path").alias("paths"))
        rows = materialise(own.join(hot, "fp").mapInArrow(_children(level), _ROWS).distinct(), "paths")
    return found


def _exact(level: float):
    """Verified links inside pairs of blocks: a count and a star for each set that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _whole_groups(batches, "key"):
            keys = rows.column("key").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            out = {"fp": [], "links": [], "root": []}
            for begin, end in zip(starts[:-1], starts[1:]):
                if end - begin < 2:
                    continue
                group = rows.slice(begin, end - begin)
                fps = group.column("fp").to_pylist()
                own, i, j = (group.column(c).to_numpy() for c in ("own", "i", "j"))
                linked = similar([np.frombuffer(raw, np.uint64) for raw in group.column("shingles").to_pylist()], level)
                if i[0] != j[0]:
                    linked &= own[:, None] != own[None, :]
                links = linked.sum(1)
                label = np.arange(len(fps))  # rows come by fp, so a label is the smallest member
                while True:
                    lower = np.minimum(label, np.where(linked, label[None, :], len(fps)).min(1))
                    if (lower == label).all():
                        break
                    label = lower
                for k in np.flatnonzero(links):
                    out["fp"].append(fps[k])
                    out["links"].append(int(links[k]))
                    out["root"].append(fps[label[k]])
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("fp", pa.binary()), ("links", pa.int64()), ("root", pa.binary())]))
    return run


def similar(sets: list[np.ndarray], level: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of the level or more; no set with itself."""
    sizes = np.array([len(s) for s in sets])
    _, which, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = seen[which] > 1  # other shingles are in one set only
    _, column = np.unique(which[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= level * union - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _classified(documents: DataFrame, keep: str, level: float = LEVEL, recall: float = RECALL, leaf: int = LEAF,
                depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The columns ``keep`` and fp of each row; fp, root, class_id, n_links, n_copies of each set.

    Sets of one class have the same root. ``keep`` is a schema that has doc_id as long.
    """
    runs = runs_for(recall)
    names = [c for c in documents.columns if c != "text"]
    rows = materialise(documents.mapInArrow(_describe(level, runs, names), f"{keep}, {_SET}, paths array<long>"), "shingle-rows")
    sets = materialise(rows.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "shingle-sets")
    groups = components(candidate_pairs(documents, sets, level, runs, leaf, depth))
    groups = materialise(groups.select(F.col("node").alias("fp"), F.col("root").alias("key")).join(
        sets.select("fp", "rep"), "fp"), "candidate-groups")
    sized = groups.join(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    pairs = _block_pairs(sized, "key", "n", block).join(sets_of(documents, groups), "fp")
    linked = (pairs.select("key", "fp", "own", "i", "j", "shingles").repartition(F.col("key")).sortWithinPartitions("key", "fp")
              .mapInArrow(_exact(level), "fp binary, links long, root binary"))
    linked = materialise(linked, "links")
    tied = components(linked.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    tied = tied.join(groups.select(F.col("fp").alias("node"), "rep"), "node")
    firsts = tied.groupBy("root").agg(F.min("rep").alias("class_id"))
    tied = tied.join(firsts, "root").select(F.col("node").alias("fp"), "root", "class_id")
    links = linked.groupBy("fp").agg(F.sum("links").alias("n_links"))
    known = materialise(sets.select("fp", "rep", "n_copies").join(tied, "fp", "left").join(links, "fp", "left").select(
        "fp", "n_copies", F.coalesce("root", "fp").alias("root"), F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return rows.drop("size", "sketch", "paths"), known


def classes(documents: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    Documents joined by links, directly or over others, have one class; its id is the smallest
    document id in it. ``n_links`` counts the other texts (distinct shingle sets) with a similarity of at
    least ``level``; ``n_copies`` the rows with the same set, the row itself included.
    """
    rows, known = _classified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long", **how)
    return rows.select("doc_id", "fp").join(known, "fp", "left").select(
        "doc_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def representatives(documents: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id, or one
    without id if none has any.

    Rows are told apart by id and text, so texts that share an id, or have none, are judged each on
    its own; a row that repeats with both stays once.
    """
    keyed = documents.withColumn("__key", row_key("doc_id", "text"))
    rows, known = _classified(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("key"), "text"),
                              "doc_id long, key binary")
    rows = rows.where("fp is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")).alias("first")
    of_set = rows.groupBy("fp").agg(first).join(known.select("fp", "root"), "fp")
    chosen = of_set.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
    others = materialise(rows.select("key").distinct().join(chosen, "key", "left_anti").withColumnRenamed("key", "__key"), "others")
    return keyed.join(F.broadcast(others) if others.count() <= SENT_IDS else others, "__key", "left_anti").dropDuplicates(["__key"]).drop("__key")
