"""A corpus pipeline of five of the operators; each stage works on all that its predecessor kept.

The columns of ``documents`` pass through the filtering stages unchanged; the
last stage returns the pieces of the packed windows.

Defined cases: a missing or empty text gets a quality score like any other and
has no language, so it leaves at the second stage; rows without a doc_id are
never learned from, take part in no group of near duplicates and are packed
with a missing doc_id; a repeated row stays once, rows that share a doc_id but
not their text are judged each for itself; documents without a label only drop
out of learning; extra columns pass through, whatever their names; an empty
table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calltide.llm import decontaminate, language, near, packing, quality, tokens
from calltide.llm.common import bound_batches, drop_written, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts."""
    bound_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, by profiles of these documents and a floor under the scores of the learned ones."""
    bound_batches(spark)
    profiles = language.fit(docs)
    return language.keep_identified(docs, profiles, language.floor(docs, profiles))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark)
    return near.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    bound_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    bound_batches(spark)
    return packing.pack(docs, tokens.default_path())


STAGES = [("quality classifier", good), ("language identification", identified), ("near duplicates", distinct), ("benchmark decontamination", clean), ("packing", packed)]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), "stage")
        drop_written(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
