"""The registered queries of this subpackage: thin calls of the operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, langid, licenses, mpegts, packing, secrets, simhash, toxicity, turn_trie, vector_codes, vector_dedup, warc
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a ledger that knows the base rules' findings in half the rows: all of docs is scanned and reported all the same
    return secrets.find_secrets_by_ledger(docs, secrets.Ledger(spark), earlier=docs.where("doc_id % 2 = 0"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_mpegts, op3_decontamination, op4_toxicity, op5_html, op6_secrets, op7_licenses, op8_simhash, op9_packing, op10_warc, op11_prefix_trie, op12_vector_codes, op13_vector_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontam.ORACLE_SQL,
        "op6_secrets": secrets.oracle_sql(),
        "op10_warc": warc.ORACLE_SQL,
        "op11_prefix_trie": turn_trie.ORACLE_SQL,
        "op12_vector_codes": vector_codes.oracle_sql(),
        "op13_vector_dedup": vector_dedup.ORACLE_SQL,
    }
