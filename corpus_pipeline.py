"""A corpus pipeline: quality, language, near duplicates, decontamination, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import compression_quality, decontaminate, jaccard_join, language_id, mixing
from kinfold.llm.common import stage, table, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from `labels`, scores at 0.3 or more."""
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of 0.65 or more."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of `benchmark`."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of documents by source, with the budget of all their tokens."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: Compression and a trained language model have no SQL; tests/llm/test_queries.py holds every stage against brute force or the SQL of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole of `documents`; each stage's rows are written and read again, and go once the next ones are written.

    Null texts count as empty and have no language, so they go at the language stage; rows with a null doc_id are judged like others and
    never removed as copies or leaks. Empty tables give no rows.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
            if held is not None:
                unstage(held)
            held = docs
    return docs
