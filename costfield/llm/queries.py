"""The operators of this package as queries over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costfield.llm import conversations, main_text, quality
from costfield.llm.decontamination import leaks
from costfield.llm.lexical_search import lexical_search
from costfield.llm.line_templates import drop_recurring_lines
from costfield.llm.near_duplicates import near_duplicates
from costfield.llm.oracles import ORACLE_SQL
from costfield.llm.packing import pack_documents
from costfield.llm.personal_data import personal_data
from costfield.llm.secrets import secrets
from costfield.llm.sharding import shard_documents
from costfield.llm.stock_packing import pack_sequences
from costfield.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.extract_main_text(pages, main_text.fit(pages))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), near=True)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("row.doc_id", "row.text", "n_lines", "n_dropped")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op11_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return pack_sequences(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_histogram_sharding, op2_secret_scan, op3_html_extraction, op4_best_fit_packing, op5_benchmark_decontamination, op6_line_dedup, op7_minhash_near_dedup, op8_token_counts, op9_pii, op10_quality_rules, op11_cutting_stock_packing, op12_lexical_search, op13_conversation_repair)}
