"""Decoding of exchange payloads; what does not decode is kept as rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field names that differ only in case from one of these are not read.
_PAYLOAD = "e string, s string, p string, q string, a bigint, T bigint, m boolean, b string, u bigint"


def payloads(lines: DataFrame) -> DataFrame:
    """(raw, body) of JSON lines without blank and ``#`` lines, ``payload`` and ``data`` wrappers taken off."""
    x = lines.where("trim(value) <> '' and not startswith(trim(value), '#')")
    inner = F.coalesce(F.get_json_object("value", "$.payload"), F.col("value"))
    return x.select(F.col("value").alias("raw"), F.coalesce(F.get_json_object(inner, "$.data"), inner).alias("body"))


def decode(lines: DataFrame) -> DataFrame:
    """Typed fields with ``kind`` (trade, quote, unknown) and ``rejected``."""
    x = payloads(lines).withColumn("v", F.from_json("body", _PAYLOAD, {"mode": "PERMISSIVE"}))
    kind = F.when(F.col("v.e") == "aggTrade", "trade").when(F.col("v.u").isNotNull() & F.col("v.b").isNotNull(), "quote").otherwise("unknown")
    qty = F.expr("try_cast(v.q as double)")
    x = x.withColumns({"kind": kind, "price": F.expr("try_cast(v.p as double)"), "qty": qty})
    bad = F.col("v.s").isNull() | (F.col("kind") == "unknown") | ((F.col("kind") == "trade") & (F.col("price").isNull() | (F.col("price") <= 0) | F.col("v.T").isNull()))
    return x.select("raw", "kind", F.col("v.s").alias("symbol"), F.col("v.T").alias("ts_ms"), F.col("v.a").alias("agg_id"), "price", "qty", F.col("v.m").alias("is_buyer_maker"), F.coalesce(bad, F.lit(True)).alias("rejected"))


def positional_bars(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """REST bars, arrays of at least eleven fields in fixed places, after the ``keys`` of their rows."""
    x = rows.select(*keys, F.explode(F.from_json("body", "array<array<string>>")).alias("r")).where("size(r) >= 11")
    f = lambda i, kind: F.try_element_at("r", F.lit(i + 1)).try_cast(kind)
    return x.select(*keys, f(0, "long").alias("open_time_ms"), f(1, "double").alias("open"), f(2, "double").alias("high"), f(3, "double").alias("low"), f(4, "double").alias("close"), f(5, "double").alias("volume"), f(6, "long").alias("close_time_ms"), f(8, "long").alias("trade_count"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key, the latest of both tables."""
    both = old.unionByName(new)
    best = F.max_by(F.struct(*both.columns), F.col(order))
    return both.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def conflicts(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys by how often they occur: unique, duplicate (same content) or conflict."""
    x = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*content)).alias("contents"))
    return x.withColumn("status", F.when(F.col("contents") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("unique"))
