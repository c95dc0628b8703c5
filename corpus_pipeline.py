"""A training corpus from raw documents: language ID, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import language, minhash, mixing, packing, radix
from pulsegrid.llm.common import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter are rejected."""
    return language.known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return radix.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of 5-word shingles."""
    return minhash.drop_near_duplicates(docs, 5, 80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and small sources up to 1.5 times, towards 0.95 of the highest entropy."""
    return mixing.mixed_documents(docs, 0.95, 1.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, 4096)


STAGES = [("language_id", known_language), ("exact_dedup", exact_dedup), ("minhash_near_dedup", near_dedup), ("mixing", mixed), ("packing", packed)]

#: Language models, near-dedup and tokenizers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
