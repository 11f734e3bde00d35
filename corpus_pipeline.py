"""Cleaning of a text corpus in stages, each of which works on all its predecessor kept.

Documents without a recognised language go, then all but one of each group of near duplicates,
then those that hold a benchmark passage; personal data in what is left is masked, and the
texts are encoded. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staffmart.llm import decontaminate, language, near, pieces, pii
from staffmart.llm.common import held_out, table
from staffmart.sources.tables import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised, or below calibrated floors, go."""
    return language.accepted(docs, held_out("doc_id", 3, 1))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a shingle similarity of 0.8 or more, the one with the smallest id stays."""
    return near.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the text."""
    return pieces.encode(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", masked),
    ("SentencePiece encoding and decoding", encoded),
]

# SQL expresses none of the learned and searched stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
