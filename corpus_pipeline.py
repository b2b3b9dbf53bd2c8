"""From raw documents to packed training sequences: five stages, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohmweave.llm.common import stored, table
from ohmweave.llm.decontam import drop_contaminated
from ohmweave.llm.langid import keep_identified
from ohmweave.llm.packing import pack
from ohmweave.llm.secrets import drop_secrets
from ohmweave.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model finds stay."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    return drop_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into training sequences."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", secret_scan),
    ("packing", packing),
]

#: Language ID learns its weights and packing runs a tokenizer: SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
