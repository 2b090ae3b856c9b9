"""Corpus pipeline: toxic and bad documents go, one of each group of near-duplicates stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan.llm import ngram_join, packing, site_quality, toxicity
from shelfscan.llm.support import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose score is under its threshold."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose posterior reaches its threshold."""
    return site_quality.reject_bad(docs, site_quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the document with the smallest id of every component."""
    return ngram_join.first_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a bin and an offset for every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_bad),
    ("ngram_jaccard", one_of_each_group),
    ("packing", pack_sequences),
]

#: Fitted models and components of near-duplicates are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
