"""Corpus pipeline: quality classifier, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and reads what its predecessor kept.  The
first three return documents with all their columns; the last one returns the
packed pieces.  No stage can be told in SQL as a whole, so there is no SQL twin;
the tests compare every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argentum.llm.common import WORD_BPE, vocabulary
from argentum.llm.near_dup import drop_near_duplicates
from argentum.llm.packing import pack_documents
from argentum.llm.quality_crf import keep_by_quality, train
from argentum.llm.quality_rules import keep_by_rules
from argentum.storage import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line-wise quality score reaches the threshold; trained on the labels table."""
    return keep_by_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the length and repetition rules."""
    return keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary(WORD_BPE))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
