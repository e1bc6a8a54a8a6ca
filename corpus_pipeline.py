"""Corpus pipeline: quality classifier, line dedup, near-duplicate join,
benchmark decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagehand.llm import decontaminate, importance, line_dedup, ngram_join, queries
from stagehand.llm.common import bound_batches, read_table
from stagehand.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text (a null text keeps what it had)."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the importance sample stay."""
    return importance.keep_sample(docs, read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave all documents but the one with the smallest id."""
    bound_batches(spark)
    return _sized(line_dedup.drop_lines(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that is nothing else goes."""
    return _sized(decontaminate.remove_hits(docs, read_table(spark, sf_dir, "benchmark"), max_hit_share=0.95))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return queries.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Hashed n-gram scores, tokenization and component search have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
