"""The corpus pipeline: quality, near duplicates, contamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of documents; the last returns doc_id, start, n_tokens and ids_crc32 of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, decontam, mixing, neardup, quality, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity of 0.8."""
    return neardup.deduplicate(docs, k=5, percent=80)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold passages of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring languages to their target weights."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as directly addressable codes and read back."""
    return tokens.token_output(docs)


STAGES = [
    ("quality", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontam_stage),
    ("mixing", mixing_stage),
    ("token output", tokens_stage),
]

#: The stages learn and encode, which SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
