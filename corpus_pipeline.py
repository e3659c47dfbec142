"""A training corpus in five stages: quality rules, exact dedup, near-dedup, source mixing, tokenising.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import exactdedup, mixing, piece_dropout, quality, simhash
from tabulon.session import scratch, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_dropout.encode_pieces(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("piece_encoding", encode_stage),
]

#: SimHash components and subword merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet and read again; what a stage wrote on its way, and the stages before the last one read, are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep_stage:
                docs = keep_stage(stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
