import numpy as np
from pyspark.sql import functions as F

from staffmart.llm import language as L
from staffmart.llm.common import held_out
from tests.llm.helpers import awkward, documents, nothing, prose

OTHER = ["ung", "ein", "der", "ch", "ß", "ä", "zu", "sch"]


def two_languages(spark, n=120):
    texts = [prose(k, 20 + k % 30, OTHER if k % 2 else ["the", "an", "ou", "th", "ea"]) for k in range(n)]
    return documents(spark, texts, ["de" if k % 2 else "en" for k in range(n)])


def test_gradients_are_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    network = L.Network(3, hidden=4, kind=np.float64)
    x, label = rng.integers(0, 256, (9, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = network.gradients(x, label)
    for name, values in network.p.items():
        places = [np.unravel_index(i, values.shape) for i in np.argsort(-np.abs(grad[name]).ravel())[:5]]
        for place in places:
            kept = values[place]
            losses = []
            for step in (1e-5, -1e-5):
                values[place] = kept + step
                losses.append(network.gradients(x, label)[0])
            values[place] = kept
            assert np.isclose((losses[0] - losses[1]) / 2e-5, grad[name][place], rtol=1e-4, atol=1e-8)


def test_pooling_covers_every_byte():
    network = L.Network(2)
    texts = [b"", b"a", b"x" * 64, b"y" * 65, b"abc " * 1000]
    pooled = network.documents(texts, most=7)
    for text, row in zip(texts, pooled):
        padded = text + b" " * (-len(text) % L.WINDOW)
        windows = np.frombuffer(padded, np.uint8).reshape(-1, L.WINDOW)
        if not text:
            assert not row.any()
            continue
        prob = network.positions(np.ascontiguousarray(windows.T)).transpose(1, 0, 2).reshape(-1, 2)[:len(text)]
        assert np.allclose(prob.mean(0), row, atol=1e-5)


def test_held_out_documents_are_recognised(spark):
    docs = two_languages(spark)
    rows = L.identify(docs, held_out("doc_id", 3, 1), epochs=12).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = two_languages(spark, 60)
    hold = held_out("doc_id", 3, 1)
    wrong = docs.withColumn("lang", F.when(hold, "xx").otherwise(F.col("lang")))
    assert sorted(L.identify(docs, hold, epochs=2).collect()) == sorted(L.identify(wrong, hold, epochs=2).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = L.identify(docs, held_out("doc_id", 3, 1), epochs=1).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and by[1].score == 0
    kept = L.accepted(docs, held_out("doc_id", 3, 1), epochs=1)
    assert kept.columns == docs.columns and not {1, 2, 3, 9} & {r.doc_id for r in kept.collect()}
    assert L.identify(nothing(spark), held_out("doc_id", 3, 1)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled, held_out("doc_id", 3, 1)).collect()} == {"und"}


def test_more_languages_than_sixty_four_are_all_learned(spark):
    langs = [f"l{k:02d}" for k in range(70) for _ in range(3)]
    texts = [f"{chr(0x4E00 + 7 * int(lang[1:]))}{chr(0x5E00 + 11 * int(lang[1:]))} " * 30 for lang in langs]
    languages, network = L.train(documents(spark, texts, langs), F.lit(True), epochs=1)
    assert languages == sorted(set(langs)) and len(network.p["bias"]) == 70


def test_languages_share_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L.Network, "fit", lambda self, x, label, epochs: seen.append(np.bincount(label)))
    L.train(two_languages(spark, 60), F.lit(True), fit_windows=1, fit_total=20)
    L.train(two_languages(spark, 60), F.lit(True), fit_windows=1, fit_total=1)
    assert [list(s) for s in seen] == [[10, 10], [1, 1]]


def test_noise_and_unlearned_languages_are_not_accepted(spark):
    docs = two_languages(spark, 400)
    noise = [prose(900 + k, 30, [c + d for c in "bcfgjkq" for d in "vwxzpm"]) for k in range(10)]
    other = [prose(950 + k, 30, ["при", "вет", "ска", "зал", "мир"]) for k in range(10)]
    bad = documents(spark, noise + other, ["xx"] * 20).withColumn("doc_id", F.col("doc_id") + 1000)
    hold = held_out("doc_id", 3, 1) | (F.col("doc_id") > 1000)
    kept = {r.doc_id for r in L.accepted(docs.union(bad), hold, keep=0.97, epochs=6).collect()}
    assert len(kept) >= 0.94 * 400 and max(kept) <= 400


def test_there_are_no_floors_without_enough_right_rows(spark):
    docs = two_languages(spark, 60)
    model = L.train(docs, ~held_out("doc_id", 3, 1), epochs=1)
    assert L.floors(docs, held_out("doc_id", 3, 1), model) == (0.0, 0.0)


def test_known_share_counts_letter_groups():
    known = np.zeros(1 << 24, bool)
    known[L.byte_groups(b"abc d")] = True
    assert [L.known_share(t, known) for t in (b"", b"ab", b"12345", b"ABC\nD", b"abcx", b"xyz")] == [1, 1, 1, 1, 0.5, 0]


def test_one_id_very_often_is_one_document(spark):
    rows = [(k, f"word{k} and more", ["en", "de"][k % 2]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(2000)).drop("id"))
    few = sorted(L._sample(docs, 20).collect())
    assert sorted(L._sample(many, 20).collect()) == few and len(few) == 40
    assert len({r.doc_id for r in few}) == 40


def test_floors_come_from_every_held_out_id(spark, monkeypatch):
    """No sample of the held-out rows: with more of them than were ever sampled, each still counts, and counts once."""
    rows = [(k, "word", "en", float(k)) for k in range(3000)] + [(0, "word", "en", 0.0)] * 50
    judged = spark.createDataFrame(rows, "doc_id long, text string, lang string, place double").select(
        "doc_id", "text", "lang", F.lit(True).alias("__hold"), F.lit("en").alias("__lang"),
        ((F.col("place") + 1) / 4000).alias("__score"), (1 - F.col("place") / 4000).alias("__known"))
    monkeypatch.setattr(L, "_labelled", lambda documents, *how, **more: judged)
    score, known = L.floors(judged.select("doc_id", "text", "lang"), F.lit(True), (["en"], None), keep=0.99)
    assert np.isclose(score, 15 / 4000, atol=2e-6) and np.isclose(known, 1 - 2985 / 4000, atol=2e-6)
