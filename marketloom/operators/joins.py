"""Point-in-time joins: as-of, aligned, interval and cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
    strict: bool = True, max_age: int | None = None, bucket_ms: int | None = None,
) -> DataFrame:
    """``left`` with the latest ``right`` row before (``strict``) or at its time, as struct ``matched``.

    One sort of the union by key and time: at equal times left rows come first
    when strict, right rows otherwise.  No row of ``right`` after the left time
    is ever seen.  Older than ``max_age`` counts as none.  With ``bucket_ms``
    the sorts are of one key and time bucket each, and the last row of all
    earlier buckets, one row a bucket, serves where a bucket has none before.
    Rows of ``right`` without a time match nothing.
    """
    r = right.where(F.col(right_time).isNotNull())
    found = r.select(F.struct(*r.columns)).schema[0].dataType
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(found).alias("_right"))
    r = r.select(*keys, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.struct(*r.columns).alias("_right"))
    part = list(keys)
    if bucket_ms is not None:
        part.append("_bucket")
        l, r = (x.withColumn("_bucket", F.floor(F.col("_t") / bucket_ms)) for x in (l, r))
    w = Window.partitionBy(*part).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = l.unionByName(r).withColumn("_match", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    if bucket_ms is not None:
        x = _carried(x, l, r, keys)
    if max_age is not None:
        x = x.withColumn("_match", F.when(F.col("_t") - F.col("_match")[right_time] <= max_age, F.col("_match")))
    return x.select("_left.*", F.col("_match").alias("matched"))


def _carried(x: DataFrame, l: DataFrame, r: DataFrame, keys: list[str]) -> DataFrame:
    """Fills ``_match`` from earlier buckets of the key: the last row of each bucket, carried over one row a bucket."""
    part = [*keys, "_bucket"]
    lasts = r.groupBy(*part).agg(F.max_by("_right", "_t").alias("_last"))
    asked = l.select(*part).distinct()
    both = asked.withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType)).unionByName(lasts)
    both = both.groupBy(*part).agg(F.first("_last", ignorenulls=True).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).where("_before is not null").drop("_last")
    match = F.lit(True)
    for c in part:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}"))
    return x.alias("x").join(both.alias("b"), match, "left").select("x._t", "x._left", F.coalesce("x._match", "b._before").alias("_match"))


def _sum_upto(events: DataFrame, points: DataFrame, keys: list[str], at: str, time: str, inclusive: bool, name: str, bucket_ms: int) -> DataFrame:
    """Adds the sum of ``_value`` over points before ``at`` (and at it); windows inside time buckets, then over the buckets' sums."""
    bucket = lambda t: F.floor(F.col(t) / bucket_ms).alias("_bucket")
    side = F.lit(2 if inclusive else 0).alias("_side")
    e = events.select(*keys, bucket(at), F.col(at).alias("_t"), side, F.lit(0.0).alias("_value"), F.struct(*events.columns).alias("_row"))
    p = points.select(*keys, bucket(time), F.col(time).alias("_t"), F.lit(1).alias("_side"), "_value", F.lit(None).cast(e.schema["_row"].dataType).alias("_row"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rangeBetween(Window.unboundedPreceding, 0)
    x = e.unionByName(p).withColumn("_near", F.sum("_value").over(inside)).where("_row is not null")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = e.select(*keys, "_bucket", "_value").unionByName(p.select(*keys, "_bucket", "_value")).groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_value"))
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_value").over(earlier), F.lit(0.0)).alias("_far"))
    return x.drop("_value").join(sums, [*keys, "_bucket"]).select("_row.*", (F.col("_near") + F.col("_far")).alias(name))


def interval_sum(events: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, time: str, value: Column, name: str, bucket_ms: int) -> DataFrame:
    """Adds the sum of ``value`` over points with start < time < end.

    The difference of two running sums, so no event is repeated; equal events
    stay as many rows.  Time buckets split the series of one key.  An event that
    ends before it starts has the sum 0; keys must not be null.
    """
    p = points.select(*keys, time, value.cast("double").alias("_value"))
    x = _sum_upto(events, p, keys, start, time, True, "_until_start", bucket_ms)
    x = _sum_upto(x, p, keys, end, time, False, "_until_end", bucket_ms)
    inside = F.when(F.col(end) > F.col(start), F.col("_until_end") - F.col("_until_start")).otherwise(F.lit(0.0))
    return x.withColumn(name, inside).drop("_until_start", "_until_end")


def forward_outcomes(bars: DataFrame, step_ms: int, horizon: int) -> DataFrame:
    """Next-open entry, ``horizon``-th close exit and path extremes of each bar, where the path is contiguous."""
    w = Window.partitionBy("symbol").orderBy("open_time_ms")
    path = w.rowsBetween(1, horizon)
    whole = F.lead("open_time_ms", horizon).over(w) == F.col("open_time_ms") + horizon * step_ms
    reason = F.when(F.lead("open_time_ms", horizon).over(w).isNull(), "OUT_OF_RANGE").when(~whole, "GAP")
    return bars.withColumns(
        {
            "entry": F.when(whole, F.lead("open", 1).over(w)), "exit": F.when(whole, F.lead("close", horizon).over(w)),
            "path_high": F.when(whole, F.max("high").over(path)), "path_low": F.when(whole, F.min("low").over(path)), "excluded": reason,
        }
    )


def midrank_percentile(by: list[str], value: str) -> Column:
    """Cross-sectional percentile with tied values at their mean rank."""
    w = Window.partitionBy(*by)
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2 - 0.5) / F.count("*").over(w)


def others_median(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the median of the other rows' values in the cross-section, from ranks and no pairs; single rows go."""
    every, ranked = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value)
    x = rows.withColumns({"_n": F.count("*").over(every), "_k": F.row_number().over(ranked)}).where("_n > 1")
    half = F.floor(F.col("_n") / 2)
    x = x.withColumns({f"_{i}": F.max(F.when(F.col("_k") == half + i, F.col(value))).over(every) for i in range(3)})
    # without the own rank k, the i-th value is that of rank i or, from k on, i + 1
    place = lambda i: F.when(half + i < F.col("_k"), F.col(f"_{i}")).otherwise(F.col(f"_{i + 1}"))
    median = F.when(F.col("_n") % 2 == 0, place(0)).otherwise((place(0) + place(1)) / 2)
    return x.withColumn(name, median).drop("_n", "_k", "_0", "_1", "_2")
