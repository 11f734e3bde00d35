import collections
import itertools
import random

import pytest

from staffmart.llm import near as N
from staffmart.llm.components import components
from tests.llm.helpers import awkward, documents, nothing, prose


def brute_force(texts):
    """(class, links, copies) of each text."""
    sets = [frozenset(s.tolist()) for s in N.shingle_sets([(t or "").encode() for t in texts])]
    different = list(dict.fromkeys(s for s in sets if s))
    root = {s: s for s in different}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = collections.Counter()
    for a, b in itertools.combinations(different, 2):
        if len(a & b) >= N.LEVEL * len(a | b):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    first, copies = {}, collections.Counter(sets)
    for k, s in enumerate(sets, 1):
        if s:
            first.setdefault(find(s), k)
    return [(first[find(s)] if s else k, links[s], copies[s] if s else 1) for k, s in enumerate(sets, 1)]


def changed(text, times, seed):
    rng = random.Random(seed)
    own = text.split()
    for _ in range(times):
        own[rng.randrange(len(own))] = prose(rng.random(), 1)
    return " ".join(own)


def corpus():
    texts = [prose(k, 60 + k % 90) for k in range(80)]
    passage = prose(999, 40)
    texts += [prose(200 + k, 60) + " " + passage + " " + prose(300 + k, 40) for k in range(60)]
    texts += [changed(texts[k], k % 5, k) for k in range(40)]
    base = prose(5000, 200)
    texts += [changed(base, 1 + k % 3, 700 + k) for k in range(70)] + [base] * 20
    return texts + [None, "", "one", "one", "one two three"]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def truth(texts):
    return brute_force(texts)


@pytest.mark.parametrize("how", [{}, {"leaf": 20, "block": 8}, {"leaf": 10, "depth": 1, "block": 16}])
def test_same_as_brute_force(spark, texts, truth, how):
    rows = sorted(N.classes(documents(spark, texts), **how).collect())
    assert [(r.class_id, r.n_links, r.n_copies) for r in rows] == truth


def test_ids_too_many_to_send(spark, texts, truth, monkeypatch):
    monkeypatch.setattr(N, "SENT_IDS", 0)
    rows = sorted(N.classes(documents(spark, texts)).collect())
    assert [(r.class_id, r.n_links, r.n_copies) for r in rows] == truth


def test_order_of_rows_and_partitions_does_not_matter(spark, texts, truth):
    docs = documents(spark, texts).repartition(13).orderBy("text")
    assert [(r.class_id, r.n_links, r.n_copies) for r in sorted(N.classes(docs).collect())] == truth


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = N.classes(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].class_id == by[6].class_id == 5 and by[6].n_copies == 3
    assert (by[1].class_id, by[2].class_id, by[3].class_id) == (1, 2, 3)
    kept = N.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert N.classes(nothing(spark)).count() == 0 and N.representatives(nothing(spark)).count() == 0


def test_runs_reach_the_recall():
    assert N.runs_for(0.9995) > N.runs_for(0.9) > 1


def test_components_of_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(50, 45), (45, 47), (47, 50), (9, 9)]
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    roots = {r.node: r.root for r in rows}
    assert len(rows) == len(roots) == 61 + 39 + 3
    assert all(roots[k] == 100 for k in range(100, 161)) and all(roots[k] == 1 for k in range(1, 40))
    assert {roots[k] for k in (45, 47, 50)} == {45}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives_are_chosen_row_by_row(spark):
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (5, changed(a, 1, 1)), (5, b), (None, changed(a, 1, 2)), (None, c), (None, changed(c, 1, 3)), (None, None), (6, None)]
    kept = N.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(1, a), (5, b), (None, None), (6, None)} <= {tuple(r) for r in kept} and len(kept) == 5
    assert sum(r.doc_id is None and r.text is not None for r in kept) == 1
