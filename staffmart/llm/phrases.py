"""Phrases of two to four words that occur together more than their parts would, per language.

Texts are lower-cased from A to Z, split into pieces at ``. , ; : ! ?`` and line breaks (x0A to x0D), and those into words at
blanks and tabs. A phrase is a run of words within a piece; f counts all its occurrences. Candidates have two words or
more and f of at least ``least``. A cut into first and rest has the score floor(2,000,000 f / (f(first) + f(rest))); that of
a candidate is its lowest, at the shortest first part if equal. A candidate inside a longer one that has at least ``share`` % of
its occurrences goes. The first ``most`` of each language are returned, by score, f (both falling) and phrase.

First pass: a chunk of texts counts its different runs exactly and deals them by 64-bit hash to partitions of the hash space.
Each partition merges what it gets into a Misra-Gries summary: with k counters, the (k + 1)-th largest count is
taken off all, so the sum of what is taken off stays under mass / (k + 1). k is over mass / ``least``, so
no run with ``least`` occurrences can be lost; those whose counter and error together reach it survive. Two runs with one
hash can only make each other survive.

Second pass: the survivors are marked in a bit field of ``2**filter_bits`` bits, and the chunks
count marked runs again under their own words, exactly. If there are too many survivors for one field, the hash space is
gone through in several parts, each with its own field. So what is sent to the tasks does not grow with the data, nor does
what a task holds: chunks have about ``chunk_bytes`` of text, and a longer text comes in slices that overlap by three words.

Null languages count as ``und``, null texts as empty. Repeated rows count as often as they are there. Other columns are
not looked at, ids included. Without candidates the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import SEED, mix, pieces, raw_texts, values
from staffmart.operators.lookup import join_found
from staffmart.operators.ordering import number_chunks, sorted_chunks
from staffmart.sources.tables import materialise

LEAST, MOST, SHARE, ORDER = 30, 2000, 80, 4
FACTOR = 2_000_000
CHUNK_BYTES = 5 << 19
FILTER_BITS = 27
# The fewest partitions of the hash space, as a power of two. A chunk has a row for each, and Spark hands rows to a task by the
# ten thousand: with 256 of them, all a task of the first pass had to merge, up to 67 MB, came at once.
PART_BITS = 12
MOST_PART_BITS = 20
PART_MASS = 1 << 26  # runs a partition should count
_PRINT_BITS = 40
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\v\f\r")] = 2
_GAP = re.compile(rb"[ \t.,;:!?\n\v\f\r]")


def slices(text: bytes, most: int) -> Iterator[tuple[bytes, bool]]:
    """Stretches of a text of about ``most`` bytes, and whether it ends there. All but the last end
    between words, hold four words or more, and their last three words come again."""
    begin, size = 0, most
    while len(text) - begin > size:
        gap = _GAP.search(text, begin + size)
        if gap is None:
            break
        own = text[begin:gap.start() + 1]
        ends = np.flatnonzero(np.diff(np.append(_CLASS[np.frombuffer(own, np.uint8)] == 0, False).astype(np.int8), prepend=0) == 1)
        if len(ends) <= ORDER:
            size *= 2
            continue
        yield own, False
        begin, size = begin + int(ends[-(ORDER - 1)]), most
    yield text[begin:] if begin else text, True


class Runs:
    """The different runs of words of some texts. ``prints``, ``counts``: by number of words, from one."""

    def __init__(self, texts: list[bytes], langs: list[str], whole: bool = True):
        self.langs = sorted(set(langs))
        index = {lang: k for k, lang in enumerate(self.langs)}
        raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        kind = _CLASS[raw]
        inner = kind == 0
        padded = np.concatenate([[False], inner, [False]])
        edge = np.flatnonzero(padded[1:] != padded[:-1])
        begin, end = edge[::2], edge[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        lang = np.array([index[x] for x in langs], np.int64)[np.searchsorted(np.cumsum(sizes), begin, "right")]
        offsets = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inner])]).dictionary_encode()
        self.words = words.dictionary
        word = self.words.to_pylist()
        own, different = pd.factorize(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(self.langs) + lang)
        self.size = max(1, len(different))
        self.word_of, self.lang_of = different // max(1, len(self.langs)), different % max(1, len(self.langs))
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs]
        base = np.fromiter((xxhash.xxh3_64_intdigest(word[w], seeds[x]) for w, x in zip(self.word_of.tolist(), self.lang_of.tolist())),
                           np.uint64, len(different))
        # Runs that start in the last three words of a slice are counted in the next one.
        active = len(begin) if whole else max(0, len(begin) - ORDER + 1)
        self.total = np.bincount(lang[:active], minlength=len(self.langs))
        at, ids, chain = np.arange(active), own[:active], base
        self.prints, self.counts = [mix(base)], [np.bincount(ids, minlength=len(different))]
        self.before, self.last = [None], [np.arange(len(different))]
        for m in range(1, ORDER):
            keep = at + m < len(begin)
            at, ids = at[keep], ids[keep]
            keep = piece[at + m] == piece[at]
            at, ids = at[keep], ids[keep]
            ids, pair = pd.factorize(ids * self.size + own[at + m])
            self.before.append(pair // self.size)
            self.last.append(pair % self.size)
            chain = mix(chain[self.before[m]] * SEED + base[self.last[m]] + np.uint64(m))
            self.prints.append(mix(chain))
            self.counts.append(np.bincount(ids, minlength=len(pair)))

    def phrases(self, m: int, own: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of some runs of ``m + 1`` words."""
        parts = []
        for j in range(m, -1, -1):
            parts.append(self.last[j][own])
            own = self.before[j][own] if j else own
        texts = [self.words.take(pa.array(self.word_of[w])) for w in parts[::-1]]
        return (pa.array(self.langs, pa.string()).take(pa.array(self.lang_of[parts[-1]])),
                pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())).cast(pa.string()))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[Runs]:
    texts, langs, size = [], [], 0
    for batch in pieces(batches):
        for text, lang in zip(raw_texts(batch), values(batch, "lang").to_pylist()):
            if len(text) > chunk_bytes:
                for own, whole in slices(text, chunk_bytes):
                    yield Runs([own], [lang], whole)
                continue
            texts.append(text)
            langs.append(lang)
            size += len(text) + 1
            if size >= chunk_bytes:
                yield Runs(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Runs(texts, langs)


def packed(prints: np.ndarray) -> bytes:
    """Five bytes each."""
    return np.ascontiguousarray(prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes | memoryview) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _blob(prints: np.ndarray, counts: np.ndarray) -> bytes:
    many = counts > 1
    n = np.array([(~many).sum(), many.sum()], "<u4")
    return n.tobytes() + packed(prints[~many]) + packed(prints[many]) + counts[many].astype("<u4").tobytes()


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    one, more = np.frombuffer(data, "<u4", 2).astype(int)
    middle = 8 + 5 * (one + more)
    return unpacked(memoryview(data)[8:middle]), np.concatenate([np.ones(one, np.int64), np.frombuffer(data, "<u4", more, middle).astype(np.int64)])


_DEALT = "part int, kind int, mass long, runs binary"


def _deal(bits: int, chunk_bytes: int) -> Callable:
    """Per chunk and partition of the hash space: a row with the mass, which is sorted first, and one with the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _chunks(batches, chunk_bytes):
            prints, counts = np.concatenate(runs.prints), np.concatenate(runs.counts)
            prints, counts = prints[counts > 0], counts[counts > 0]
            order = np.argsort(prints)
            prints, counts = prints[order], counts[order]
            part = (prints >> np.uint64(64 - bits)).astype(np.int64)
            prints = (prints >> np.uint64(64 - bits - _PRINT_BITS)) & np.uint64((1 << _PRINT_BITS) - 1)
            own, first = np.unique(part, return_index=True)
            ends = np.append(first[1:], len(part))
            mass = [int(counts[a:b].sum()) for a, b in zip(first, ends)]
            blobs = [_blob(prints[a:b], counts[a:b]) for a, b in zip(first, ends)]
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(own, 2), pa.int32()), pa.array([0] * n + [1] * n, pa.int32()), pa.array(mass + [0] * n, pa.int64()),
                 pa.array([None] * n + blobs, pa.binary())], names=["part", "kind", "mass", "runs"])
    return run


class Summary:
    """A Misra-Gries summary of at most ``room`` counters; ``error`` bounds what any count has lost."""

    def __init__(self, room: int):
        self.room, self.error = room, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(self.room, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.room:
            off = int(np.partition(self.counts, len(self.counts) - self.room - 1)[len(self.counts) - self.room - 1])
            stay = self.counts > off
            self.keys, self.counts, self.error = self.keys[stay], self.counts[stay] - off, self.error + off

    def survivors(self, least: int) -> np.ndarray:
        """Sorted keys that may have been seen ``least`` times."""
        self.merge()
        return self.keys[self.counts + self.error >= least]


_KEPT = "part int, survivors long, error long, prints binary"


def _summarise(least: int) -> Callable:
    """Rows sorted by partition of the hash space, mass first: the survivors of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def close() -> pa.RecordBatch:
            keep = summary.survivors(least)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([len(keep)], pa.int64()), pa.array([summary.error], pa.int64()),
                 pa.array([packed(keep)], pa.binary())], names=["part", "survivors", "error", "prints"])

        for batch in batches:
            for p, kind, m, runs in zip(*(values(batch, c) for c in ("part", "kind", "mass", "runs"))):
                if p.as_py() != part:
                    if summary is not None:
                        yield close()
                    part, mass, summary = p.as_py(), 0, None
                if kind.as_py() == 0:
                    mass += m.as_py()
                    continue
                if summary is None:
                    summary = Summary(mass // least + 1)
                summary.add(*_unblob(runs.as_py()))
        if summary is not None:
            yield close()
    return run


def _field(bits: int, group_bits: int, filter_bits: int) -> Callable:
    """The stretch of the bit field that belongs to each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = 1 << (filter_bits - bits + group_bits)
        for batch in batches:
            for part, prints in zip(values(batch, "part"), values(batch, "prints")):
                marks = np.zeros(length, bool)
                marks[(unpacked(prints.as_py()) >> np.uint64(_PRINT_BITS - filter_bits + bits - group_bits)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())],
                                                 names=["part", "marks"])
    return run


_COUNTED = "lang string, words int, phrase string, n long"


def _count(sent, group: int, group_bits: int, filter_bits: int, chunk_bytes: int) -> Callable:
    """Marked runs of one part of the hash space with their counts; in the first part also all words, as words = 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(sent.value, np.uint8)

        def rows(lang: pa.Array, words: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), words, np.int32)), phrase, pa.array(n.astype(np.int64))],
                                              names=["lang", "words", "phrase", "n"])

        for runs in _chunks(batches, chunk_bytes):
            if group == 0:
                yield rows(pa.array(runs.langs, pa.string()), 0, pa.nulls(len(runs.langs), pa.string()), runs.total)
            for m in range(ORDER):
                prints, counts = runs.prints[m], runs.counts[m]
                at = ((prints << np.uint64(group_bits)) >> np.uint64(64 - filter_bits)).astype(np.int64)
                marked = ((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & (counts > 0)
                if group_bits:
                    marked &= (prints >> np.uint64(64 - group_bits)) == group
                found = np.flatnonzero(marked)
                for k in range(0, len(found), 50_000):
                    own = found[k:k + 50_000]
                    lang, phrase = runs.phrases(m, own)
                    yield rows(lang, m + 1, phrase, counts[own])
    return run


def frequent(documents: DataFrame, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES, filter_bits: int = FILTER_BITS,
             part_bits: int = PART_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all runs of up to four words with f of at least ``least``, and (lang, n) of all words."""
    spark = documents.sparkSession
    given = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MOST_PART_BITS, max(part_bits, (size // PART_MASS).bit_length()))  # about one run a byte at most
    dealt = given.mapInArrow(_deal(bits, chunk_bytes), _DEALT).repartition("part").sortWithinPartitions("part", "kind")
    kept = materialise(dealt.mapInArrow(_summarise(least), _KEPT), "survivors")
    survivors = kept.agg(F.sum("survivors").alias("n")).first()["n"] or 0
    # One mark in sixteen at most, if the parts are even.
    group_bits = min(bits, (max(0, survivors - 1) >> (filter_bits - 4)).bit_length())
    counted = None
    for group in range(1 << group_bits):
        own = kept.where(F.shiftright("part", bits - group_bits) == group)
        field = bytearray(1 << (filter_bits - 3))
        stretch = len(field) >> (bits - group_bits)
        for row in own.mapInArrow(_field(bits, group_bits, filter_bits), "part int, marks binary").toLocalIterator():
            place = (row["part"] & ((1 << (bits - group_bits)) - 1)) * stretch
            field[place:place + stretch] = row["marks"]
        sent = spark.sparkContext.broadcast(bytes(field))
        found = given.mapInArrow(_count(sent, group, group_bits, filter_bits, chunk_bytes), _COUNTED)
        found = materialise(found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where(
            (F.col("f") >= least) | (F.col("words") == 0)), "counted")
        counted = found if counted is None else counted.unionByName(found)
        sent.unpersist()
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def _joined(words: str, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(documents: DataFrame, least: int = LEAST, most: int = MOST, share: int = SHARE, **how: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language."""
    known, totals = frequent(documents, least, **how)
    candidates = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct("lang", _joined("w", F.lit(1), F.col("k")).alias("phrase")).alias("first"),
                       F.struct("lang", _joined("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("phrase")).alias("rest"))
    by_phrase = known.select(F.struct("lang", "phrase").alias("key"), "f")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = join_found(cuts, by_phrase.select(F.col("key").alias(part), F.col("f").alias(name)), part)
    # Decimal, since the product may pass 64 bits; the quotient is a million at most.
    score = F.expr(f"cast({FACTOR} as decimal(10, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    inner = candidates.where(F.size("w") > 2).select(
        "lang", F.col("a").alias("_longer"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "_longer", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i")).select(
        F.struct("lang", _joined("w", F.col("i"), F.col("m")).alias("phrase")).alias("key"), "_longer")
    longest = inner.groupBy("key").agg(F.max("_longer").alias("_longer"))
    scored = join_found(scored.withColumn("key", F.struct("lang", "phrase")), longest, "key")
    inside = F.lit(100).cast("decimal(3, 0)") * F.col("_longer").cast("decimal(20, 0)") >= F.lit(share).cast("decimal(10, 0)") * F.col("a").cast("decimal(20, 0)")
    scored = scored.where(~F.coalesce(inside, F.lit(False))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    placed = sorted_chunks(scored, ["lang", F.desc("score"), F.desc("a"), "phrase"], "phrases")
    placed = materialise(number_chunks(placed, "_place"), "placed")
    begins = placed.groupBy("lang").agg(F.min("_place").alias("_begin")).join(totals, "lang")
    rank = F.col("_place") - F.col("_begin") + 1
    return (join_found(placed, begins, "lang").withColumn("rank", rank).where(F.col("rank") <= most)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
