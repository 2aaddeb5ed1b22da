"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and
reads it again as the next stage's docs. All but the last return the columns of documents. A stage
that filters keeps rows of empty or null text unless the classifier rejects them or they are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugewright.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from gaugewright.llm.common import cut, drop_cut, scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal documents."""
    return exact_dedup.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_duplicates", unlike), ("decontamination", clean), ("packing", packed)]
#: Not in SQL: the classifier's training, the join and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(cut(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
