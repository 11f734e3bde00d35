import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from staffmart.llm import decontaminate as D
from tests.llm.helpers import awkward, documents, nothing, prose

BENCH = "item_id long, text string"


def brute_force(docs, items):
    found = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = D.words((text or "").encode()), D.words((item or "").encode())
        for s in range(len(a) - D.WINDOW + 1):
            for t in range(len(b) - D.WINDOW + 1):
                if sum(x != y for x, y in zip(a[s:s + D.WINDOW], b[t:t + D.WINDOW])) <= D.SUBSTITUTIONS:
                    found.add((d, i))
    return found


def test_masks_hit_every_window_with_the_allowed_substitutions():
    for wrong in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(all(s + m not in wrong for m in mask) for mask in D.MASKS for s in range(D.WINDOW - D.SPAN + 1))
    assert all(max(mask) < D.SPAN for mask in D.MASKS)


def planted():
    rng = random.Random(5)
    items = [(k, prose(100 + k, 13 + k % 20)) for k in range(15)]
    docs = []
    for k in range(60):
        own = prose(k, 40 + k).split()
        if k % 3 == 0:
            passage = items[k % 15][1].split()
            for _ in range(k % 5):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(own))
            own[at:at] = passage
        docs.append((k + 1, " ".join(own).replace(" ", ", ", 2)))
    return docs, items


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_same_as_brute_force_in_one_block_or_many(spark, block_words):
    docs, items = planted()
    found = D.overlaps(documents(spark, [t for _, t in docs]), spark.createDataFrame(items, BENCH), block_words=block_words)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute_force(docs, items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows}) and len(rows) > 10
    for r in rows:
        assert D.WINDOW <= r.overlap_words == r.end_word - r.start_word <= r.item_words


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_WORDS", 50)
    item = prose(7, 400)
    docs = [" ".join(item.split()[k:k + 14]) for k in range(0, 380, 9)]
    found = D.overlaps(documents(spark, docs), spark.createDataFrame([(1, item)], BENCH))
    assert found.count() == len(docs)


def short_by_hand(docs, items):
    """Every item of fewer words than a window against every text."""
    found = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = D.words((text or "").encode()), D.words((item or "").encode())
        if D.SPAN <= len(b) < D.WINDOW:
            hit = any(a[s:s + len(b)] == b for s in range(len(a) - len(b) + 1))
        else:
            parts = [D.words(p.encode()) for p in re.split("[.!?\r\n]", text or "")]
            hit = 0 < len(b) < D.SPAN and (a == b or (len(b) >= D.SENTENCE_WORDS and b in parts))
        if hit:
            found.add((d, i))
    return found


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_items_shorter_than_a_window(spark, block_words):
    rng = random.Random(3)
    items = [(k, prose(500 + k, 1 + k % 12)) for k in range(48)] + [(90, "What, is THIS then?"), (91, ""), (92, "two words")]
    docs = []
    for k in range(150):
        own, item = prose(1000 + k, rng.randint(0, 12)), items[k % 48][1]
        docs.append((k + 1, rng.choice([item, f"{own} {item} {own}", f"{own}. {item}! {own}", f"{own}\n{item}\n{own}", f"{own}. {item} {own}.",
                                        f"{own} {item[:-1]}", f"{item}.\n", own])))
    docs += [(900, "So. what is this, then? Yes"), (901, "what is this then and there"), (902, "Two words."), (903, "Two words. More"), (904, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = D.overlaps(frame, spark.createDataFrame(items, BENCH), block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == short_by_hand(docs, items)
    assert len({r.item_words for r in rows}) == 12
    texts = dict(docs)
    for r in rows:
        assert D.words(texts[r.doc_id].encode())[r.start_word:r.end_word] == D.words(dict(items)[r.item_id].encode())
        assert r.overlap_words == r.item_words == r.end_word - r.start_word


def test_awkward_rows(spark):
    docs = awkward(spark)
    long = docs.where("doc_id = 4").first().text.split()
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, " ".join(long[5000:5030])),
                                   (4, " ".join(long[-20:])), (4, " ".join(long[-20:]))], BENCH + "")
    rows = D.overlaps(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id or 0) for r in rows)) == [(4, 0), (4, 4)]
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert D.overlaps(nothing(spark), items).count() == 0
    assert D.overlaps(docs, items.where("item_id = 3")).count() == 0
    assert D.clean(docs, items.where(F.lit(False))).count() == docs.count()


def test_only_the_row_that_overlaps_goes(spark):
    passage = prose(77, 20)
    rows = [(None, prose(1, 30) + " " + passage), (None, prose(2, 30)), (None, None), (3, passage), (3, prose(4, 30)), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = D.clean(docs, spark.createDataFrame([(1, passage)], BENCH)).collect()
    assert {tuple(r) for r in kept} == {rows[k] for k in (1, 2, 4, 5)} and len(kept) == 4
