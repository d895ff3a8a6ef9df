"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, exact_dedup, line_dedup, minhash, mixing, quality, secrets, spelling, suffix_dedup, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": lambda spark, d: suffix_dedup.query(table(spark, d, "documents")),
        "op2_minhash_dedup": lambda spark, d: minhash.query(table(spark, d, "documents")),
        "op3_topk": lambda spark, d: topk.query(table(spark, d, "embeddings")),
        "op4_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_bpe": lambda spark, d: bpe.query(table(spark, d, "documents")),
        "op6_url_filter": lambda spark, d: url_filter.query(table(spark, d, "pages")),
        "op7_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
        "op8_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
        "op9_secrets": lambda spark, d: secrets.query(table(spark, d, "documents")),
        "op10_quality": lambda spark, d: quality.query(table(spark, d, "documents")),
        "op11_spelling": lambda spark, d: spelling.query(table(spark, d, "documents")),
        "op12_conversation_repair": lambda spark, d: conversations.query(table(spark, d, "conversations")),
        "op13_exact_dedup": lambda spark, d: exact_dedup.query(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": topk.ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op9_secrets": secrets.oracle(),
        "op11_spelling": spelling.ORACLE,
        "op12_conversation_repair": conversations.oracle(),
        "op13_exact_dedup": exact_dedup.ORACLE,
    }
