"""Validation, de-duplication, gaps and resampling of bars and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def _key() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time_ms")


def violations() -> Column:
    """Names of the rules that a bar breaks."""
    rules = {
        "price": F.least("open", "high", "low", "close") <= 0, "high": F.col("high") < F.greatest("open", "close"), "low": F.col("low") > F.least("open", "close"),
        "taker": F.col("taker_quote") > F.col("quote_volume"), "time": F.col("close_time_ms") < F.col("open_time_ms"),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items())))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def gaps(bars: DataFrame, step_ms: int) -> DataFrame:
    """(symbol, after_ms, before_ms, missing) for each gap between neighbours."""
    x = bars.select("symbol", F.lag("open_time_ms").over(_key()).alias("after_ms"), F.col("open_time_ms").alias("before_ms"))
    return x.where(F.col("before_ms") - F.col("after_ms") > step_ms).withColumn("missing", F.expr(f"(before_ms - after_ms) div {step_ms} - 1"))


def resample(bars: DataFrame, step_ms: int, target_ms: int) -> DataFrame:
    """Complete aligned bars of ``target_ms``; a bar with a missing part does not appear."""
    parts = target_ms // step_ms
    t = F.expr(f"open_time_ms - pmod(open_time_ms, {target_ms}L)")
    agg = bars.groupBy("symbol", t.alias("bucket_ms")).agg(
        F.min_by("open", "open_time_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time_ms").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"), F.count("*").alias("n"), (F.max("open_time_ms") - F.min("open_time_ms")).alias("span"),
    )
    return agg.where((F.col("n") == parts) & (F.col("span") == target_ms - step_ms)).drop("n", "span")


def quality_summary(bars: DataFrame, step_ms: int) -> DataFrame:
    g = F.col("open_time_ms") - F.lag("open_time_ms").over(_key())
    x = bars.withColumn("_g", g)
    return x.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("open_time_ms").alias("first_ms"), F.max("open_time_ms").alias("last_ms"),
        F.count_if(F.col("_g") > step_ms).alias("gap_count"), F.coalesce(F.sum(F.when(F.col("_g") > step_ms, F.expr(f"_g div {step_ms} - 1"))), F.lit(0)).alias("missing"),
    )


def trade_bars(trades: DataFrame, step_ms: int) -> DataFrame:
    """Bars of trade counts, signed flow and its share."""
    signed = F.when(F.col("is_buyer_maker"), -F.col("price") * F.col("qty")).otherwise(F.col("price") * F.col("qty"))
    b = trades.groupBy("symbol", F.expr(f"ts_ms - pmod(ts_ms, {step_ms}L)").alias("open_time_ms")).agg(
        F.count("*").alias("n_trades"), F.min_by("price", F.struct("ts_ms", "agg_id")).alias("open"), F.max_by("price", F.struct("ts_ms", "agg_id")).alias("close"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.sum(signed).alias("signed_notional"),
    )
    return b.withColumn("signed_share", F.when(F.col("notional") > 0, F.col("signed_notional") / F.col("notional")))


def derived_bars(parts: DataFrame, natives: DataFrame, part_ms: int, whole_ms: int) -> DataFrame:
    """Bars of ``whole_ms`` from closed ones of ``part_ms``, held against the venue's own, with sums that are exact.

    ``parts`` and ``natives``: symbol, open_time_ms, open, high, low, close,
    volume, quote_volume (decimals) and trade_count.  Returns symbol,
    open_time_ms, the derived values, n_parts and status: incomplete (a part is
    missing), foreign (a part off the grid or twice), unmatched (no native bar),
    close, volume or count (that value differs, the first that does), else
    ready.  Sums are of decimals, so they are equal or not, without a tolerance.
    """
    need = whole_ms // part_ms
    whole = F.expr(f"open_time_ms - pmod(open_time_ms, {whole_ms}L)")
    off = F.col("open_time_ms") % part_ms != 0
    x = parts.groupBy("symbol", whole.alias("_open")).agg(
        F.min_by("open", "open_time_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time_ms").alias("close"),
        F.sum("volume").cast("decimal(38,18)").alias("volume"), F.sum("quote_volume").cast("decimal(38,18)").alias("quote_volume"), F.sum("trade_count").alias("trade_count"),
        F.count("*").alias("n_parts"), F.count_distinct("open_time_ms").alias("_slots"), F.max(off).alias("_off"),
    )
    own = natives.select("symbol", F.col("open_time_ms").alias("_open"), F.col("close").alias("_c"), F.col("volume").alias("_v"), F.col("quote_volume").alias("_q"), F.col("trade_count").alias("_n"))
    x = x.join(own, ["symbol", "_open"], "left")
    status = F.when(F.col("_off") | (F.col("_slots") < F.col("n_parts")), "foreign").when(F.col("n_parts") < need, "incomplete").when(F.col("_c").isNull(), "unmatched")
    status = status.when(F.col("close") != F.col("_c"), "close").when((F.col("volume") != F.col("_v")) | (F.col("quote_volume") != F.col("_q")), "volume").when(F.col("trade_count") != F.col("_n"), "count").otherwise("ready")
    return x.select("symbol", F.col("_open").alias("open_time_ms"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "n_parts", status.alias("status"))
