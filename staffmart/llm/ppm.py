"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order`` with the counts of what followed. A byte
is coded in the longest context seen in learning; if it never followed there, the coder pays for an
escape (number of different followers over that number plus their occurrences) and goes on one
byte shorter, where the followers already ruled out are left out of all counts; below the empty context the
bytes left are equally likely. A text ends with an end mark, and starts in a context of such marks.

Counts come from all learning texts, and no task needs the whole model. Documents are packed into blocks of
about ``block_bytes``; a block yields its different byte groups and words with their counts. Totals are
summed by key, the code length of each different group is worked out once, by joins on
its shorter contexts, and each block gets back what its own texts need. A key has at most one row
per block. Words are counted under 64-bit hashes, of which a billion different words share
one with a probability of about 3 %.

Also returned is a word score: the sum over tokens (lower-cased words and one end per text) of
log10((c + 1) / (N + V + 1)). Null and empty texts consist of the end alone. Without learning texts
every byte costs log10(257). Rows that repeat give repeated results. Other columns are not
looked at. A single text may be longer than a block. ``adaptive`` scores each text on its own, learning as it goes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffmart.llm.common import SEED, pieces, raw_texts, values
from staffmart.sources.tables import materialise, work_path

ORDER = 3
BLOCK_BYTES = 12 << 20
MARK = 256  # the end of a text, and what stands before its start
SYMBOLS = 257
_PART = 1 << 20  # bytes worked on at once
_WORD, _GROUP = 0, 1


class Trie:
    """The same model for one text after another, in plain Python."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.followers: dict[tuple, dict[int, int]] = {}

    def learn(self, context: tuple, symbol: int) -> None:
        for j in range(self.order + 1):
            own = self.followers.setdefault(context[self.order - j:], {})
            own[symbol] = own.get(symbol, 0) + 1

    def cost(self, context: tuple, symbol: int) -> float:
        """log10 of the symbol's probability."""
        total, out = 0.0, set()
        for j in range(self.order, -1, -1):
            own = {s: n for s, n in self.followers.get(context[self.order - j:], {}).items() if s not in out}
            if not own:
                continue
            weight = sum(own.values()) + len(own)
            if symbol in own:
                return total + math.log10(own[symbol] / weight)
            total += math.log10(len(own) / weight)
            out.update(own)
        return total - math.log10(SYMBOLS - len(out))

    def text(self, text: bytes, learn: bool) -> float:
        context, total = (MARK,) * self.order, 0.0
        for symbol in [*text, MARK]:
            total += self.cost(context, symbol)
            if learn:
                self.learn(context, symbol)
            context = (*context, symbol)[1:]
        return total


def groups(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every coded symbol with its context as one number (9 bits a symbol), and symbols per text."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n = int(sizes.sum()) + order * len(texts)
    symbols = np.full(n, MARK, np.int64)
    begin = np.cumsum(sizes + order) - sizes  # first coded symbol of each text
    coded = np.ones(n, bool)
    for t, at in zip(texts, begin.tolist()):
        symbols[at:at + len(t)] = np.frombuffer(t, np.uint8)
        coded[at - order:at] = False
    code = np.zeros(n, np.int64)
    for k in range(order, -1, -1):
        code[order:] |= symbols[order - k:n - k] << (9 * k)
    return code[coded], sizes


def tokens(text: bytes) -> np.ndarray:
    own = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _PART bytes."""
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > _PART:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _counted(keys: np.ndarray, learned: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different keys with how often they were learned from."""
    yield np.unique(keys[learned], return_counts=True)
    unlearned = np.unique(keys[~learned])
    yield unlearned, np.zeros(len(unlearned), np.int64)


def _pack(order: int, block_bytes: int):
    def row(ids, held, texts):
        words, codes = [], []
        for a, b in _parts([len(t) for t in texts]):
            learned = np.array([not h for h in held[a:b]])
            own = [tokens(t) for t in texts[a:b]]
            words += _counted(np.concatenate(own), np.repeat(learned, [len(o) for o in own]))
            seen, sizes = groups(texts[a:b], order)
            codes += _counted(seen, np.repeat(learned, sizes))
        (words, word_n), (codes, code_n) = _summed(words), _summed(codes)
        return {"block": uuid.uuid4().int >> 65, "ids": ids, "held": held, "texts": texts, "words": words,
                "word_n": word_n, "codes": codes, "code_n": code_n,
                "tokens": int(word_n.sum()) + sum(not h for h in held)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        for batch in pieces(batches):
            schema = pa.schema([
                ("block", pa.int64()), ("ids", pa.list_(batch.schema.field("doc_id").type)), ("held", pa.list_(pa.bool_())),
                ("texts", pa.list_(pa.binary())), ("words", pa.list_(pa.int64())), ("word_n", pa.list_(pa.int64())),
                ("codes", pa.list_(pa.int64())), ("code_n", pa.list_(pa.int64())), ("tokens", pa.int64())])
            ids += values(batch, "doc_id").to_pylist()
            held += values(batch, "held_out").to_pylist()
            own = raw_texts(batch)
            texts += own
            size += sum(map(len, own))
            if size >= block_bytes:
                yield pa.RecordBatch.from_pylist([row(ids, held, texts)], schema)
                ids, held, texts, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([row(ids, held, texts)], schema)
    return run


def code_costs(codes: DataFrame, order: int) -> DataFrame:
    """(code, cost): log10 probability of the last symbol of each code in the context before it.

    ``codes`` has every code met anywhere and ``n``, its count in learning. All frames hold one row per
    different byte group, so their size follows the variety of the texts, not their length.
    """
    def tail(length: int) -> Column:
        return F.col("code").bitwiseAND(F.lit((1 << (9 * length)) - 1))

    counted = {order + 1: codes.where("n > 0")}
    for length in range(order, 0, -1):
        counted[length] = counted[length + 1].select(tail(length).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))
    out = codes.select("code")
    for j in range(order, -1, -1):
        own = counted[j + 1]
        if j:
            shorter = counted[j].select(F.col("code").alias("short"), F.col("n").alias("below"))
            followers = own.join(shorter, tail(j) == F.col("short"))
        else:
            followers = own.withColumn("below", F.lit(0).cast("long"))
        context = followers.groupBy(F.shiftright("code", 9).alias(f"context{j}")).agg(
            F.sum("n").alias(f"total{j}"), F.count(F.lit(1)).alias(f"different{j}"), F.sum("below").alias(f"below{j}"))
        out = out.join(own.select(F.col("code").alias(f"group{j}"), F.col("n").alias(f"n{j}")), tail(j + 1) == F.col(f"group{j}"), "left")
        out = out.join(context, F.shiftright("code", 9).bitwiseAND(F.lit((1 << (9 * j)) - 1)) == F.col(f"context{j}"), "left")
    cost, found = F.lit(0.0), F.lit(False)
    ruled_out, ruled_kinds = F.lit(0), F.lit(0)
    for j in range(order, -1, -1):
        n, total, different = (F.coalesce(F.col(f"{c}{j}"), F.lit(0)) for c in ("n", "total", "different"))
        left, kinds = total - ruled_out, different - ruled_kinds
        here = F.when(n > 0, F.log10(n / (left + kinds))).when(kinds > 0, F.log10(kinds / (left + kinds))).otherwise(F.lit(0.0))
        cost = cost + F.when(found, F.lit(0.0)).otherwise(here)
        found = found | (n > 0)
        ruled_out, ruled_kinds = F.coalesce(F.col(f"below{j}"), F.lit(0)), different
    cost = cost - F.when(found, F.lit(0.0)).otherwise(F.log10(SYMBOLS - ruled_kinds))
    return out.select("code", cost.alias("cost"))


class Lookup:
    """Values by key for many keys at once: a table of hashed places first, a binary search for the rest."""

    def __init__(self, keys: np.ndarray, amounts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.amounts = keys[order], amounts[order]
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 2))
        self.place = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.place[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SEED) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.amounts[at]


def _score(order: int):
    def run(packed: pa.Table, facts: pa.Table) -> pa.Table:
        kind, key, value = (facts.column(c).to_numpy() for c in ("kind", "key", "value"))
        cost = Lookup(key[kind == _GROUP], value[kind == _GROUP])
        count = Lookup(key[kind == _WORD], value[kind == _WORD]) if (kind == _WORD).any() else None
        packed = packed.combine_chunks()
        out = {c: [] for c in ("n_tokens", "n_known", "logs", "score")}
        for p in range(packed.num_rows):
            texts = packed.column("texts").chunk(0)[p].values
            for a, b in _parts(pc.binary_length(texts).to_pylist()):
                own = texts.slice(a, b - a).to_pylist()
                codes, sizes = groups(own, order)
                out["score"].append(np.add.reduceat(cost(codes), np.cumsum(sizes) - sizes))
                seen = [tokens(t) for t in own]
                owner = np.repeat(np.arange(len(own)), [len(s) for s in seen])
                counts = count(np.concatenate(seen)) if len(owner) else np.empty(0)
                out["n_tokens"].append(np.array([len(s) + 1 for s in seen], np.int64))
                out["n_known"].append(np.bincount(owner, counts > 0, len(own)).astype(np.int64))
                out["logs"].append(np.bincount(owner, np.log10(counts + 1), len(own)).astype(np.float64))
        ids, held = (pa.concat_arrays([packed.column(c).chunk(0)[p].values for p in range(packed.num_rows)]) for c in ("ids", "held"))
        return pa.table([ids, held, *(pa.array(np.concatenate(v)) for v in out.values())], names=["doc_id", "held_out", *out])
    return run


def score(documents: DataFrame, hold: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows without ``hold``."""
    given = documents.select("doc_id", hold.alias("held_out"), "text")
    kind, spark = dict(documents.dtypes)["doc_id"], documents.sparkSession
    blocks = work_path(spark, "text-blocks")
    schema = (
        f"block long, ids array<{kind}>, held array<boolean>, texts array<binary>, words array<long>, word_n array<long>, "
        "codes array<long>, code_n array<long>, tokens long")
    given.mapInArrow(_pack(order, block_bytes), schema).write.option("compression", "zstd").parquet(blocks)
    packed = spark.read.schema(schema).parquet(blocks)

    def exploded(keys: str, counts: str) -> DataFrame:
        return packed.select("block", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(counts).alias("n"))).alias("x")).select(
            "block", "x.key", "x.n")

    words, codes = exploded("words", "word_n"), exploded("codes", "code_n")
    totals = materialise(codes.groupBy(F.col("key").alias("code")).agg(F.sum("n").alias("n")), "byte-groups")
    costs = materialise(code_costs(totals, order), "code-lengths")
    # A word has at most one row per block. Each gets the total; one of them is marked to count the word.
    of_word = Window.partitionBy("key")
    words = words.select("block", "key", F.sum("n").over(of_word).alias("n"),
                         (F.col("block") == F.min("block").over(of_word)).alias("first"))
    words = materialise(words, "word-totals")
    learned = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    different = words.where("first AND n > 0").count()
    ends = packed.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    different += ends > 0
    facts = words.select("block", F.lit(_WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionAll(
        codes.join(costs, F.col("key") == F.col("code")).select("block", F.lit(_GROUP).alias("kind"), "key", F.col("cost").alias("value")))
    facts = facts.toDF(*facts.columns)  # columns of its own, as both sides come from one table
    scored = packed.select("block", "ids", "held", "texts").groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(
        _score(order), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double")
    shift = math.log10(learned + different + 1)
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(learned)).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - F.col("n_tokens") * shift).alias("base_score"), "score")


def _adaptive(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            costs = [Trie(order).text(t, learn=True) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([values(batch, "doc_id"), pa.array(costs, pa.float64())], names=["doc_id", "score"])
    return run


def adaptive(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and score of each text under a model that learns from that text alone as it goes."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_adaptive(order), f"doc_id {kind}, score double")
