import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from staffmart.llm import phrases as M
from tests.llm.helpers import awkward, documents, nothing


def runs(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
        words = re.findall(r"[^\x20\x09]+", piece)
        for i in range(len(words)):
            for m in range(1, min(4, len(words) - i) + 1):
                yield tuple(words[i:i + m])


def plain(rows, least, most, share=80):
    """(lang, text) rows."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for run in runs(text):
            f[lang or "und", run] += 1
            n[lang or "und"] += len(run) == 1
    found = collections.defaultdict(list)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, run), a in candidates.items():
        inside = any(100 * b >= share * a and any(q[i:i + len(run)] == run for i in range(len(q) - len(run) + 1))
                     for (other, q), b in candidates.items() if other == lang and len(q) > len(run))
        if not inside:
            score, k = min((2_000_000 * a // (f[lang, run[:k]] + f[lang, run[k:]]), k) for k in range(1, len(run)))
            found[lang].append((-score, -a, " ".join(run).encode(), f[lang, run[:k]], f[lang, run[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
                  for lang, own in found.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:most], 1))


def some(seed, texts, words=12, vocabulary=9):
    rng = random.Random(seed)
    known = ["the", "New", "york", "é", "Straße", "a-b", "x'y", "co op", "𝒳"][:vocabulary]
    return [(rng.choice(["en", "de", None]), "".join(
        rng.choice(known) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "?"]) for _ in range(rng.randint(0, words)))) for _ in range(texts)]


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 300}, {"filter_bits": 11, "part_bits": 3, "chunk_bytes": 2000}])
def test_brute_force(spark, how):
    rows = some(1, 200)
    df = documents(spark, [t for _, t in rows], [lang for lang, _ in rows]).repartition(3)
    assert result(M.collocations(df, 5, 20, **how)) == plain(rows, 5, 20)
    assert result(M.collocations(df, 3, 5000, **how)) == plain(rows, 3, 5000)


def test_long_texts_come_in_slices(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["aa", "b", "ccc", "d" * 50]) + rng.choice([" ", " ", "\t\t", ", ", ".\n"]) for _ in range(20_000))
    assert result(M.collocations(documents(spark, [text]), 30, 50, chunk_bytes=1000)) == plain([("en", text)], 30, 50)
    unbroken = "".join(rng.choice(["aa", "b", "ccc"]) + " " for _ in range(5_000)) + "z" * 30_000
    assert result(M.collocations(documents(spark, [unbroken]), 30, 50, chunk_bytes=500)) == plain([("en", unbroken)], 30, 50)
    for body in (b"", b"a", b"x" * 5000, b"a b " * 1000, b". " * 3000):
        assert b"".join(s for s, whole in M.slices(body, 100) if whole) in body


def test_no_frequent_run_is_lost():
    rng = np.random.default_rng(5)
    for room_of in (1, 3):
        keys = rng.zipf(1.3, 20_000).clip(max=5000).astype(np.uint64)
        least = 30
        summary = M.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 50 * room_of):
            summary.add(*np.unique(part, return_counts=True))
            summary.merge()
        known, counts = np.unique(keys, return_counts=True)
        kept = summary.survivors(least)
        assert set(known[counts >= least]) <= set(kept)
        assert summary.error * (summary.room + 1) <= len(keys) and len(summary.keys) <= summary.room


def test_packing():
    prints = np.array([0, 1, (1 << 40) - 1, 77], np.uint64)
    assert M.unpacked(M.packed(prints)).tolist() == prints.tolist()
    keys, counts = M._unblob(M._blob(prints, np.array([1, 5, 1, 70_000])))
    assert dict(zip(keys.tolist(), counts.tolist())) == {0: 1, (1 << 40) - 1: 1, 1: 5, 77: 70_000}


def test_products_past_64_bits(spark):
    a = 3 * 10**13
    row = spark.createDataFrame([(a, a + 7, a + 1)], "a long, l long, r long")
    score = M.F.expr(f"cast({M.FACTOR} as decimal(10, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    assert row.select(score.alias("s")).first().s == M.FACTOR * a // (2 * a + 8)


def test_awkward_rows(spark):
    df = awkward(spark)
    expected = plain([(r.lang, r.text) for r in df.collect()], 2, 30)
    assert result(M.collocations(df, 2, 30)) == expected
    assert M.collocations(nothing(spark)).count() == 0
    assert M.collocations(documents(spark, [None, "", "one two"])).count() == 0


def test_rows_that_reach_a_task_at_once_are_bounded():
    """Spark hands over ten thousand rows at once; every other row of a chunk has counts."""
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(380_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text[:M.CHUNK_BYTES]]})
    for out in M._deal(M.PART_BITS, M.CHUNK_BYTES)(iter([batch])):
        assert sum(len(b) for b in out.column("runs").to_pylist() if b) / out.num_rows * 10_000 < 16 << 20
