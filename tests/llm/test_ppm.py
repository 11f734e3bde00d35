import collections
import math
import zlib

import pytest

from staffmart.llm import ppm as M
from staffmart.llm.common import held_out
from tests.llm.helpers import awkward, documents, nothing, prose


def brute_force(rows, order):
    """Scores of (id, text) rows by the plain trie and plain counts."""
    learned = [(t or "").encode() for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    trie, count = M.Trie(order), collections.Counter()
    for text in learned:
        context = (M.MARK,) * order
        for symbol in [*text, M.MARK]:
            trie.learn(context, symbol)
            context = (*context, symbol)[1:]
        count.update(text.lower().split())
        count["end"] += 1
    total, different = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = (t or "").encode().lower().split() + ["end"]
        base = sum(math.log10((count[w] + 1) / (total + different + 1)) for w in tokens)
        out.append((i, len(tokens), sum(count[w] > 0 for w in tokens), total, base, trie.text((t or "").encode(), False)))
    return out


def same(rows, expected):
    def key(r):
        return (r[0] or 0, *map(float, r[1:4]), round(r[4], 6))
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=key)
    expected = sorted(expected, key=key)
    assert [r[:4] for r in rows] == [e[:4] for e in expected]
    for r, e in zip(rows, expected):
        assert r[4] == pytest.approx(e[4], rel=1e-9) and r[5] == pytest.approx(e[5], rel=1e-9)


@pytest.mark.parametrize("order, block", [(3, M.BLOCK_BYTES), (3, 500), (2, 3000), (4, 3000)])
def test_same_as_the_trie(spark, order, block):
    texts = [prose(k, 5 + k % 20) for k in range(40)] + [None, "", "x", "Été\tA a", "é" * 30, " \n "]
    docs = documents(spark, texts)
    rows = M.score(docs, held_out("doc_id", 7, 2), order, block).collect()
    same(rows, brute_force(list(enumerate(texts, 1)), order))


def test_probabilities_of_all_symbols_sum_to_one():
    trie = M.Trie(2)
    for text in (b"abracadabra", b"abbey", b""):
        trie.text(text, learn=True)
    for context in [(97, 98), (256, 256), (1, 2), (114, 97)]:
        assert sum(10**trie.cost(context, s) for s in range(M.SYMBOLS)) == pytest.approx(1)


def test_adaptive_scores_do_not_depend_on_other_texts(spark):
    texts = ["abcabcabcabc", "", None, "abcabcabcabc"]
    rows = {r.doc_id: r.score for r in M.adaptive(documents(spark, texts)).collect()}
    assert rows[1] == rows[4] == pytest.approx(M.Trie().text(b"abcabcabcabc", True)) and rows[2] == rows[3] == pytest.approx(-math.log10(257))


def test_learned_prose_costs_less_than_noise(spark):
    docs = documents(spark, [prose(k, 100) for k in range(30)] + ["zq xj! " * 80])
    rows = {r.doc_id: r.score / r.n_tokens for r in M.score(docs, held_out("doc_id", 7, 2)).collect()}
    assert rows[31] < min(rows[k] for k in range(1, 31)) or zlib.crc32(b"31") % 7 != 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = M.score(docs, held_out("doc_id", 7, 2)).collect()
    assert len(rows) == docs.count()
    same([r for r in rows if r.doc_id != 4], [e for e in brute_force([(r.doc_id, r.text) for r in docs.collect()], M.ORDER) if e[0] != 4])
    assert M.score(nothing(spark), held_out("doc_id", 7, 2)).count() == 0
    none = M.score(docs.where("doc_id is null"), held_out("doc_id", 7, 2)).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)} and min(r.score for r in none) == pytest.approx(-12 * math.log10(257))
