"""Domain views over the star-schema and event tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: lineitem rows by return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        epoch_ms("l_shipdate").alias("ts_ms"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("quote"),
        (F.col("l_linestatus") == "O").alias("is_buyer_maker"),
        F.round(F.col("l_discount") * 100).cast("long").alias("drift"),
        F.round(F.col("l_tax") * 100).cast("long").alias("spread"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("lots"),
    )


def candles(spark: SparkSession, sf_dir: str, step_ms: int = DAY_MS) -> DataFrame:
    """Closed bars of ``step_ms`` by symbol; sums are of whole cents, so bars do not depend on row order."""
    maker = F.when(~F.col("is_buyer_maker"), F.col("cents")).otherwise(F.lit(0))
    bars = (
        prints(spark, sf_dir)
        .groupBy("symbol", F.expr(f"ts_ms - pmod(ts_ms, {step_ms}L)").alias("open_time_ms"))
        .agg(
            F.sum("drift").alias("drift"), F.sum("spread").alias("spread"), F.count("*").alias("trade_count"),
            (F.sum("lots") / 100.0).alias("volume"), (F.sum("cents") / 100.0).alias("quote_volume"), (F.sum(maker) / 100.0).alias("taker_quote"),
        )
    )
    w = Window.partitionBy("symbol").orderBy("open_time_ms")
    step = F.round(F.col("drift") * 1000000.0 / F.col("trade_count") / 100.0).cast("long") - 50000
    bars = bars.withColumn("close", F.round(F.lit(100.0) * F.exp(F.sum(step).over(w) / 1000000.0), 6))
    bars = bars.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    width = F.col("spread") / F.col("trade_count") / 1000.0
    return bars.select(
        "symbol", "open_time_ms", (F.col("open_time_ms") + (step_ms - 1)).alias("close_time_ms"), "open",
        F.round(F.greatest("open", "close") * (1 + width), 6).alias("high"), F.round(F.least("open", "close") * (1 - width), 6).alias("low"),
        "close", "volume", "quote_volume", "taker_quote", "trade_count",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events: one symbol for each event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("agg_id"), "user_id",
        F.round(F.lit(100) + F.col("value"), 4).alias("price"), (1 + F.col("user_id") % 7).cast("double").alias("qty"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for each symbol and eight hours with ticks, from the mean price of that time."""
    t = ticks(spark, sf_dir).withColumn("funding_time_ms", F.expr(f"ts_ms - pmod(ts_ms, {8 * HOUR_MS}L) + {8 * HOUR_MS}L"))
    mills = F.sum(F.round(F.col("price") * 10000).cast("long")) / F.count("*") / 10000.0
    return t.groupBy("symbol", "funding_time_ms").agg(F.round((mills - 300) / 100000, 8).alias("rate"))


PRINTS = """prints as (select l_returnflag as symbol, epoch_ms(cast(l_shipdate as timestamp)) as ts_ms, l_quantity as qty, l_extendedprice as quote, l_linestatus = 'O' as is_buyer_maker,
 cast(round(l_discount * 100) as bigint) as drift, cast(round(l_tax * 100) as bigint) as spread, cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_quantity * 100) as bigint) as lots from lineitem)"""


def candles_sql(step_ms: int = DAY_MS) -> str:
    return f"""{PRINTS}, bars as (select symbol, ts_ms - ts_ms % {step_ms} as open_time_ms, cast(sum(drift) as bigint) as drift, cast(sum(spread) as bigint) as spread, count(*) as trade_count,
 cast(sum(lots) as double) / 100 as volume, cast(sum(cents) as double) / 100 as quote_volume, cast(sum(case when not is_buyer_maker then cents else 0 end) as double) / 100 as taker_quote from prints group by 1, 2),
walked as (select *, round(100.0::double * exp(cast(sum(cast(round(drift * 1000000.0::double / trade_count / 100.0::double) as bigint) - 50000) over (partition by symbol order by open_time_ms) as double) / 1000000.0::double), 6) as close from bars),
opened as (select *, coalesce(lag(close) over (partition by symbol order by open_time_ms), 100.0::double) as open, cast(spread as double) / trade_count / 1000.0::double as width from walked),
candles as (select symbol, open_time_ms, open_time_ms + {step_ms - 1} as close_time_ms, open, round(greatest(open, close) * (1 + width), 6) as high, round(least(open, close) * (1 - width), 6) as low, close, volume, quote_volume, taker_quote, trade_count from opened)"""


TICKS = """ticks as (select event_type as symbol, epoch_us(cast(ts as timestamp)) // 1000 as ts_ms, event_id as agg_id, user_id, round(100 + value, 4) as price, cast(1 + user_id % 7 as double) as qty, event_id % 2 = 0 as is_buyer_maker from events)"""
FUNDING = f"""{TICKS}, funding as (select symbol, ts_ms - ts_ms % {8 * HOUR_MS} + {8 * HOUR_MS} as funding_time_ms, round((cast(sum(cast(round(price * 10000) as bigint)) as double) / count(*) / 10000.0::double - 300) / 100000, 8) as rate from ticks group by 1, 2)"""
