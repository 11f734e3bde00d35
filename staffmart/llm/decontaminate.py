"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at six of eight neighbouring words and ignore the others. Their hashes over
the benchmark meet their hashes over the documents; around every hit the two texts are laid
side by side and compared word by word. Windows of ``window`` words with at most ``substitutions``
different words count, and those that adjoin form one stretch. The two masks hit every
window of 13 words with up to two substitutions, so nothing of that kind is missed.

The benchmark goes to the tasks in blocks of at most ``block_words`` words, each sent once and
met by all documents; a larger benchmark means more blocks, not larger ones.

Words are lower-cased (A-Z) runs without white space and ASCII punctuation. An item with fewer words than a window
counts where all of it lies in a text word for word; it is found by the same masks, which any eight equal words hit. One
of four to seven words, too short for a mask, counts where it makes up a whole sentence, line or text, and one of up to three where
it makes up a whole text: such words lie inside sentences of clean texts too often. They are looked up by all their words. Null and
empty texts match nothing. Repeated documents or items give
one row per document id and item id; a null id is a value like any other. Other columns of the
inputs are not looked at.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import mix, odd_numbers, pieces, raw_texts, row_key, values

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))  # the looked-at places
SPAN = 8
BLOCK_WORDS = 2_000_000
PART_WORDS = 4096  # longer items are cut into overlapping parts
SENTENCE_WORDS = 4  # shorter items count as whole texts only
_SENTENCE = re.compile(rb"[.!?\r\n]+")
_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_RESULT = "item_id long, overlap_words long, item_words long, start_word long, end_word long"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANK).split()


def _item_parts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = {"item_id": [], "item_words": [], "part": [], "words": []}
            for item, text in zip(values(batch, "item_id").to_pylist(), raw_texts(batch)):
                own = words(text)
                if not own:
                    continue
                for start in range(0, max(1, len(own) - window + 1), PART_WORDS):
                    out["item_id"].append(item)
                    out["item_words"].append(len(own))
                    out["part"].append(start)
                    out["words"].append(b" ".join(own[start:start + PART_WORDS + window - 1]))
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("item_id", pa.int64()), ("item_words", pa.int64()), ("part", pa.int64()), ("words", pa.binary())]))
    return run


def benchmark_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list]:
    """The benchmark's parts, at most about ``block_words`` words at a time."""
    parts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_parts(window), "item_id long, item_words long, part long, words binary").distinct()
    total = parts.agg(F.sum(F.least(F.col("item_words"), F.lit(PART_WORDS + window)))).first()[0] or 0
    blocks = -(-total // block_words)
    for b in range(blocks):
        yield parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == b).collect()


class Index:
    """Hashes of one block's masks and where they come from."""

    def __init__(self, rows: list):
        split = [bytes(r["words"]).split() for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        for own in split:
            for w in own:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.item = [r["item_id"] for r in rows]
        self.item_words = [r["item_words"] for r in rows]
        # Items too short for a mask, by their words.
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        for k, own in enumerate(split):
            if self.item_words[k] < SPAN:
                self.short.setdefault(tuple(own), []).append(k)
        size = np.array([len(s) for s in split], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.ids = np.fromiter((self.vocabulary[w] for s in split for w in s), np.int64, int(size.sum()))
        part = np.repeat(np.arange(len(rows)), size)
        self.seeds = []
        for m, mask in enumerate(MASKS):
            h = mask_hashes(self.ids, mask, m)
            at = np.flatnonzero(part[:len(h)] == part[SPAN - 1:SPAN - 1 + len(h)])
            order = np.argsort(h[at], kind="stable")
            self.seeds.append((h[at][order], at[order], part[at][order]))


def mask_hashes(ids: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash at each place with room for the mask."""
    n = max(0, len(ids) - SPAN + 1)
    x = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for offset, factor in zip(mask, odd_numbers(len(mask), salt)):
        h += x[offset:offset + n] * factor
    return mix(h)


def _candidates(ids: np.ndarray, index: Index) -> np.ndarray:
    """Different (place in the batch - place in the block, part) of all hash hits."""
    found = []
    for m, (mask, (hashes, place, part)) in enumerate(zip(MASKS, index.seeds)):
        n = max(0, len(ids) - SPAN + 1)
        known = np.ones(n, bool)  # words outside the benchmark match nothing
        for offset in mask:
            known &= ids[offset:offset + n] > 0
        at = np.flatnonzero(known)
        if not len(at) or not len(hashes):
            continue
        h = np.zeros(len(at), np.uint64)
        for offset, factor in zip(mask, odd_numbers(len(mask), m)):
            h += ids[at + offset].astype(np.uint64) * factor
        h = mix(h)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        count = high - low
        hit = np.repeat(np.arange(len(at)), count)
        which = np.repeat(low, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        found.append(np.stack([at[hit] - place[which], part[which]], 1))
    if not found:
        return np.empty((0, 2), np.int64)
    return np.unique(np.concatenate(found), axis=0)


def short_matches(text: bytes, size: int, short: dict[tuple[bytes, ...], list[int]]) -> Iterator[tuple[int, int, int]]:
    """(part, first word, words) of the short items that a text of ``size`` words consists of or holds as a sentence or line."""
    if size < SPAN:
        for part in short.get(tuple(words(text)), ()):
            yield part, 0, size
    at = 0
    for sentence in _SENTENCE.split(text):
        own = words(sentence)
        if SENTENCE_WORDS <= len(own) < min(SPAN, size):
            for part in short.get(tuple(own), ()):
                yield part, at, len(own)
        at += len(own)


def _matches(send, window: int, substitutions: int, key: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(send.value)
        known = index.vocabulary.get
        for batch in pieces(batches):
            keys = values(batch, key).to_pylist()
            split = [words(t) for t in raw_texts(batch)]
            size = np.array([len(s) + SPAN for s in split], np.int64)  # a gap of unknown words after each
            end = np.cumsum(size)
            begin = end - size
            ids = np.zeros(int(end[-1]), np.int64)
            for s, at in zip(split, begin):
                ids[at:at + len(s)] = np.fromiter(map(known, s, repeat(0)), np.int64, len(s))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            candidates = _candidates(ids, index)
            for shift, part in candidates.tolist():
                low, high = int(index.start[part]), int(index.end[part])
                # the part at this shift may lie over several documents; each has its own stretch
                first = int(np.searchsorted(end, max(0, low + shift), "right"))
                last = int(np.searchsorted(end, min(len(ids), high + shift) - 1, "right"))
                for d in range(first, min(last, len(split) - 1) + 1):
                    a = max(low + shift, int(begin[d]))
                    z = min(high + shift, int(end[d]) - SPAN)
                    span = min(window, index.item_words[part])
                    if z - a < span:
                        continue
                    equal = ids[a:z] == index.ids[a - shift:z - shift]
                    sums = np.concatenate([[0], np.cumsum(equal)])
                    good = np.flatnonzero(sums[span:] - sums[:-span] >= span - (substitutions if span == window else 0))
                    if not len(good):
                        continue
                    runs = np.split(good, np.flatnonzero(np.diff(good) > window) + 1)
                    run_ = max(runs, key=lambda g: g[-1] - g[0])
                    length = int(run_[-1] - run_[0]) + span
                    begun = a + int(run_[0]) - int(begin[d])
                    if length > best.get((d, part), (0, 0, 0))[0]:
                        best[d, part] = (length, begun, begun + length)
            for d, text in enumerate(raw_texts(batch) if index.short else ()):
                for part, first, length in short_matches(text, len(split[d]), index.short):
                    best.setdefault((d, part), (length, first, first + length))
            out = {key: [], "item_id": [], "overlap_words": [], "item_words": [], "start_word": [], "end_word": []}
            for (d, part), (length, begun, done) in best.items():
                for name, value in zip(out, (keys[d], index.item[part], length, index.item_words[part], begun, done)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([(n, kind if n == key else pa.int64()) for n in out]))
    return run


def _found(texts: DataFrame, benchmark: DataFrame, kind: pa.DataType, window: int, substitutions: int, block_words: int) -> DataFrame:
    """All matches of ``texts``, a key of this kind and text, over all blocks."""
    spark, key = texts.sparkSession, texts.columns[0]
    schema = f"{key} {texts.dtypes[0][1]}, {_RESULT}"
    found = None
    for rows in benchmark_blocks(benchmark, window, block_words):
        send = spark.sparkContext.broadcast(rows)
        block = texts.mapInArrow(_matches(send, window, substitutions, key, kind), schema)
        found = block if found is None else found.unionAll(block)
    return spark.createDataFrame([], schema) if found is None else found


def overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and benchmark item that share a stretch of ``window`` words or more, or all of a shorter item.

    ``overlap_words`` is the length of the longest stretch, which lies at words
    ``start_word`` to ``end_word`` (exclusive) of the document.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _found(texts, benchmark, pa.int64(), window, substitutions, block_words)
    best = F.max(F.struct("overlap_words", "item_words", "start_word", "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns; each row is judged by
    its own text, also where rows share an id or have none."""
    keyed = documents.withColumn("__key", row_key("doc_id", "text"))
    found = _found(keyed.select("__key", "text"), benchmark, pa.binary(), WINDOW, SUBSTITUTIONS, BLOCK_WORDS)
    return keyed.join(found.select("__key").distinct(), "__key", "left_anti").drop("__key")
