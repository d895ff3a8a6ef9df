"""Causal window features on bars; every frame ends at the current or the previous row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def key() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time_ms")


def segment() -> WindowSpec:
    return Window.partitionBy("symbol", "seg").orderBy("open_time_ms")


def with_segments(bars: DataFrame, step_ms: int) -> DataFrame:
    """``seg``: number of the contiguous run of bars; a gap starts a new one."""
    gap = F.coalesce(F.col("open_time_ms") - F.lag("open_time_ms").over(key()) != step_ms, F.lit(True))
    return bars.withColumn("seg", F.sum(gap.cast("long")).over(key()))


def trailing_sum(df: DataFrame, by: list[str], time: str, span: int, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over rows from ``span`` before a row's time up to that time, both included.

    Such a span is a row's own bucket of ``span`` up to it and the end of the
    bucket before: two running sums, each inside one bucket, so that neither a
    frame is added up row by row nor one key is one task.  Rows without a time
    are summed together, as SQL's range frames do.
    """
    part = Window.partitionBy(*by, "_bucket")
    x = df.withColumns({"_value": value, "_bucket": F.floor(F.col(time) / span)})
    points = x.where(F.col(time).isNotNull())
    rows = x.withColumn("_own", F.sum("_value").over(part.orderBy(time).rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.select(*by, (F.col("_bucket") - 1).alias("_bucket"), (F.col(time) - span).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(x.schema["_value"].dataType).alias("_value"), "_own", F.struct(*df.columns).alias("_row"))
    points = points.select(*by, "_bucket", F.col(time).alias("_t"), F.lit(0).alias("_side"), "_value", F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    end = F.sum("_value").over(part.orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(points).withColumn("_end", end).where("_row is not null")
    return both.select("_row.*", F.coalesce(F.col("_own") + F.col("_end"), "_own", "_end").alias(name))


def full(value: Column, window: WindowSpec, rows: int) -> Column:
    """``value`` where the frame has all ``rows`` rows."""
    return F.when(F.count(F.lit(1)).over(window) == rows, value)


def last(n: int) -> WindowSpec:
    return segment().rowsBetween(-(n - 1), 0)


def prior(n: int) -> WindowSpec:
    return segment().rowsBetween(-n, -1)


def bollinger_width(n: int = 20, deviations: float = 2.0) -> Column:
    mean = F.avg("close").over(last(n))
    return full(F.when(mean != 0, 2 * deviations * F.stddev_pop("close").over(last(n)) / F.abs(mean)), last(n), n)


def prior_zscore(column: str, n: int = 30) -> Column:
    """Against strictly earlier rows; 0 with fewer than two of them or no spread."""
    mean, spread = F.avg(column).over(prior(n)), F.stddev_pop(column).over(prior(n))
    return F.when((F.count(column).over(prior(n)) >= 2) & (spread > 0), (F.col(column) - mean) / spread).otherwise(F.lit(0.0))


def true_range() -> Column:
    before = F.lag("close").over(segment())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def flow_pressure(n: int = 20) -> Column:
    """Signed taker quote over quote volume, between -1 and 1."""
    total = F.sum("quote_volume").over(last(n))
    return F.when(total > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(2 * F.col("taker_quote") - F.col("quote_volume")).over(last(n)) / total))).otherwise(F.lit(0.0))


def efficiency_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Kaufman efficiency ratio as ``efficiency``."""
    moved = bars.withColumn("step", F.abs(F.col("close") - F.lag("close").over(segment())))
    path = F.sum("step").over(last(n))
    value = F.when(F.count("step").over(last(n)) == n, F.when(path > 0, F.abs(F.col("close") - F.lag("close", n).over(segment())) / path).otherwise(F.lit(0.0)))
    return moved.withColumn("efficiency", value).drop("step")


def pivots(left: int = 2, right: int = 2) -> dict[str, Column]:
    """Confirmed fractal highs and lows: strict on the left, weak on the right.

    A pivot is known ``right`` rows later; ``known_rn`` says from which row on.
    """
    before, after = segment().rowsBetween(-left, -1), segment().rowsBetween(1, right)
    whole = (F.count(F.lit(1)).over(before) == left) & (F.count(F.lit(1)).over(after) == right)
    high = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after))
    low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after))
    return {"pivot_high": high, "pivot_low": low, "known_rn": F.row_number().over(segment()) + right}


def window_features(bars: DataFrame, step_ms: int) -> DataFrame:
    """Range, volume, band, flow, momentum and volatility features of each bar."""
    x = with_segments(bars, step_ms)
    base = F.avg("volume").over(prior(20))
    x = x.withColumns(
        {
            "recent_high": F.max("high").over(prior(20)),
            "recent_low": F.min("low").over(prior(20)),
            "previous_close": F.lag("close").over(segment()),
            "relative_volume": F.when(base > 0, F.col("volume") / base).otherwise(F.lit(1.0)),
            "width": bollinger_width(),
            "volume_zscore": prior_zscore("volume"),
            "trade_count_zscore": prior_zscore("trade_count"),
            "cvd_pressure": flow_pressure(),
            "true_range": true_range(),
            "vwma20": full(F.sum(F.col("close") * F.col("quote_volume")).over(last(20)) / F.sum("quote_volume").over(last(20)), last(20), 20),
            "prior_median": full(F.percentile("close", F.lit(0.5)).over(prior(12)), prior(12), 12),
            "momentum": F.log(F.lag("close", 3).over(segment()) / F.lag("close", 24).over(segment())),
            "support": full(F.min("low").over(segment().rowsBetween(-36, -13)), segment().rowsBetween(-36, -13), 24),
        }
    )
    back = F.filter(F.collect_list("width").over(last(120)), lambda w: w <= F.col("width"))
    return x.withColumns({"width_percentile": F.when(F.col("width").isNotNull(), 100.0 * F.size(back) / F.count("width").over(last(120))), "atr20": full(F.avg("true_range").over(last(20)), last(20), 20)})
