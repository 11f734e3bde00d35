import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staffmart.llm import pieces as P
from tests.llm.helpers import awkward, documents, nothing, prose

sentencepiece = pytest.importorskip("sentencepiece")
if not os.path.exists(P.MODEL):
    pytest.skip("no model file", allow_module_level=True)


@pytest.fixture(scope="module")
def tables():
    return P.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def by_search(encoder, texts):
    ids, offsets = encoder.batch(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


ALPHABET = "abcdeinorst ABC   \n\t.,é日本\x00€\U0001f600\"<>/s1234567890"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=80), min_size=1, max_size=20))
def test_same_ids_as_the_library(tables, library, texts):
    assert by_search(P.Encoder(tables), texts) == [library.encode(t) for t in texts]


def test_runs_and_words(tables, library):
    texts = ["a" * 3000, " " * 100, " " * 37 + "lead" + " " * 5, prose(1, 500), "\n\n \n", "The quick brown fox.\nEt voilà, ça va?", ""]
    assert by_search(P.Encoder(tables), texts) == [library.encode(t) for t in texts]


def test_parts_of_a_batch_give_the_same(tables, library, monkeypatch):
    monkeypatch.setattr(P, "INDEXED", 50)
    texts = [prose(k, 30) for k in range(8)]
    assert by_search(P.Encoder(tables), texts) == [library.encode(t) for t in texts]


def test_occurrences_are_all_found(tables):
    encoder = P.Encoder(tables)
    text = "the other then inthe"
    place = {c: k + 1 for k, c in enumerate(encoder.letters.tolist())}
    codes = P.np.array([place[ord(c)] for c in text] + [0])
    start, piece = encoder._edges(codes)
    usable = {tables["texts"][i]: i for i in encoder.piece.tolist()}
    expected = {(a, usable[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in usable}
    assert set(zip(start.tolist(), piece.tolist())) == expected and len(start) == len(expected)


def test_round_trip_in_spark(spark):
    texts = ["▁ literal ▁▁ marks", " lead", "tail ", "日本\U0001f600", None, "", prose(3, 2000), "\\n</s>"]
    docs = documents(spark, texts)
    encoded = P.encode(docs, check=True)
    assert all(r.restored and r.n_ids == len(r.ids) for r in encoded.collect())
    back = {r.doc_id: r.text for r in P.decode(encoded).collect()}
    assert [back[k] for k in range(1, len(texts) + 1)] == [t or "" for t in texts]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = P.encode(docs, keep=("doc_id", "lang", "score"), check=True).collect()
    assert len(rows) == docs.count() and all(r.restored for r in rows)
    assert P.encode(nothing(spark)).count() == 0
    assert P.decode(P.encode(nothing(spark))).count() == 0
