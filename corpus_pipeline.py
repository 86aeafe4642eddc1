"""Corpus pipeline: five stages over ``documents``, each reading what the one before it kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents. Rows that repeat wholly,
null texts and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import op1_decontaminate, op2_quality, op4_langid, op6_pieces, op7_simhash
from lexigrove.llm.common import forget, saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return op4_langid.known_language(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more stay; labels are read from ``sf_dir``."""
    return op2_quality.good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id."""
    return op7_simhash.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op1_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, N-best scores, round trip."""
    return op6_pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: No stage but decontamination has a form in SQL; tests/llm/test_pipeline.py holds run() and each stage against brute-force
#: versions, where the scores of languages and quality are the operators' own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
            forget(before)  # written whole, so nothing reads what it was made from
    return docs
