import os

import pytest

import corpus_pipeline
from staffmart.llm import near, pieces
from staffmart.llm.queries import llm_queries
from tests.llm.helpers import DOCUMENTS, prose

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus whose outcome is known: what is planted goes, and clean documents stay."""
    path = str(tmp_path_factory.mktemp("sf"))
    passage = prose(9000, 30)
    rows = [(k, prose(k, 40 + k % 50), "en") for k in range(90)]
    rows += [(100 + k, prose(k, 40 + k % 50), "en") for k in range(20)]
    rows += [(200 + k, prose(400 + k, 30) + " " + passage + " " + prose(500 + k, 30), "en") for k in range(10)]
    rows += [(300, "12345 67", "en"), (301, None, "en"), (302, prose(600, 50) + " a.b@mail.example.org " + prose(601, 50), "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, prose(9001, 25))], BENCH).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_what_is_planted_goes_and_the_rest_stays(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    texts = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert set(texts) == {*range(90), 302}
    assert "[EMAIL]" in texts[302] and "@" not in texts[302]
    assert texts[5] == prose(5, 45)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0, name


def test_stage_of_near_duplicates_keeps_one_of_each_class(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, folder).collect()}
    assert kept == {r.class_id for r in near.classes(docs).collect()}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", list(llm_queries()))
def test_queries_cover_their_table(spark, name):
    rows = llm_queries()[name](spark, SF_DIR)
    if name in ("op8_decontaminate", "op9_neighbours", "op5_chat"):
        assert rows.count() > 0
    else:
        ids = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id")
        assert sorted(rows.select("doc_id").collect()) == sorted(ids.collect())
