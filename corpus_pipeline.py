"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and its rows are written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import jaccard_join, mixing, quality, secret_scan, sentencepiece_codec
from tremor.llm.common import keep
from tremor.llm.queries import piece_model


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8 or more."""
    return jaccard_join.drop_near_duplicates(docs, k=5, percent=80)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are replaced in the texts; every document stays."""
    return secret_scan.redact_secrets(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it (0 to 3 times)."""
    return mixing.apply_mix(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text."""
    return sentencepiece_codec.encode(docs, piece_model(), decoded=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("mixing", stage_mixing),
    ("encode", stage_encode),
]

#: The classifier, the cube method and the encoder have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
