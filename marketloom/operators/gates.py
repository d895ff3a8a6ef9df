"""Admission of rows: closed paths, ordered series, context alignment, entry picks, episodes and due slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monotone(df: DataFrame, by: str, arrival: list[str], number: str) -> DataFrame:
    """Rows whose number is above all that arrived before for the same key; late and repeated ones go."""
    before = F.max(number).over(Window.partitionBy(by).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(number) > F.col("_before"))).drop("_before")


def path_failures(df: DataFrame, path: list[str], identity: list[str], step_ms: int, delay_ms: int) -> DataFrame:
    """(path, n, latest_event_ms, latest_receipt_ms, failure) of paths of closed bars.

    failure is that of the first failing row in time, null if there is none;
    within a row the checks hold in the order in which they are written here.
    Paths are bounded stretches, so a window over one path stays small.
    """
    c = F.col
    w = Window.partitionBy(*path).orderBy("open_time_ms", "event_ms")
    last = F.last(F.struct(*identity, "close_time_ms")).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = df.withColumns({"_last": last, "_open": F.lag("open_time_ms").over(w), "_close": F.lag("close").over(w)})
    drift = F.lit(False)
    for name in identity:
        drift = drift | ~c(name).eqNullSafe(c(f"_last.{name}"))
    code = (
        F.when(drift, "IDENTITY_DRIFT")
        .when((c("open_time_ms") % step_ms != 0) | (c("close_time_ms") != c("open_time_ms") + step_ms - 1) | ~c("closed"), "ROW_NOT_CLOSED")
        .when(c("event_ms") < c("close_time_ms"), "EVENT_PRECEDES_CLOSE")
        .when(c("receipt_ms") < c("event_ms"), "RECEIPT_PRECEDES_EVENT")
        .when(c("receipt_ms") > c("_last.close_time_ms") + delay_ms, "RECEIPT_AFTER_CUTOFF")
        .when(c("open_time_ms") != c("_open") + step_ms, "GAP_OR_DUPLICATE")
        .when(c("previous_close") != c("_close"), "CLOSE_CHAIN_MISMATCH")
    )
    x = x.withColumn("_code", code)
    first = F.min(F.when(c("_code").isNotNull(), F.struct("open_time_ms", "event_ms", "_code")))
    return x.groupBy(*path).agg(F.count("*").alias("n"), F.max("event_ms").alias("latest_event_ms"), F.max("receipt_ms").alias("latest_receipt_ms"), first["_code"].alias("failure"))


def series_check(df: DataFrame, by: str, time: str, value: str, start: int, end: int) -> DataFrame:
    """(by, n, outside, repeated, not_finite, accepted): whether times are unique and in range and values finite."""
    each = df.groupBy(by, time).agg(F.count("*").alias("_c"), F.count_if(~F.coalesce(F.abs(value) < float("inf"), F.lit(False))).alias("_bad"))
    outside = F.sum(F.when(~F.col(time).between(start, end), F.col("_c")).otherwise(0))
    x = each.groupBy(by).agg(F.sum("_c").alias("n"), outside.alias("outside"), F.sum(F.col("_c") - 1).alias("repeated"), F.sum("_bad").alias("not_finite"))
    return x.withColumn("accepted", (F.col("outside") == 0) & (F.col("repeated") == 0) & (F.col("not_finite") == 0))


def alignment_failures(long: Column, contexts: dict[str, str]) -> Column:
    """Texts of what keeps higher time frames (name -> struct column with price, fast, slow) from backing a direction."""

    def failure(name: str, column: str) -> Column:
        price, fast, slow = (F.col(f"{column}.{f}") for f in ("price", "fast", "slow"))
        aligned = F.when(long, (price > fast) & (fast > slow)).otherwise((price < fast) & (fast < slow))
        return F.when(slow.isNull(), f"missing {name}").when(~aligned, f"{name} not aligned")

    return F.array_compact(F.array(*(failure(n, c) for n, c in contexts.items())))


def context_adjusted(score: Column, long: Column, near: str, far: str) -> Column:
    """Score with 5 more for each context that confirms, 10 less where the far one opposes, kept in 0..100; 0 stays 0."""
    price, fast, slow = (F.col(f"{far}.{f}") for f in ("price", "fast", "slow"))
    up = F.col(f"{near}.fast") > F.col(f"{near}.slow")
    down = F.col(f"{near}.fast") < F.col(f"{near}.slow")
    trend = F.when(F.when(long, up).otherwise(down), 5).otherwise(0)
    confirms = F.when(F.when(long, price > fast).otherwise(price < fast), 5).otherwise(0)
    opposes = F.when(F.when(long, (price < fast) & (fast < slow)).otherwise((price > fast) & (fast > slow)), 10).otherwise(0)
    return F.when(score == 0, score).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score + trend + confirms - opposes)))


def entry_pick(df: DataFrame, slot: list[str], score: str, family: str, number: str) -> DataFrame:
    """One candidate for each slot: highest score, then family, then number; an aggregate, so no slot is sorted."""
    best = F.min_by(F.struct(score, family, number), F.struct(-F.col(score), F.col(family), F.col(number)))
    return df.groupBy(*slot).agg(best.alias("_best")).select(*slot, "_best.*")


def first_of_episodes(df: DataFrame, by: str, order: list[str], ends: Column, wanted: Column) -> DataFrame:
    """The first wanted row of each episode; an episode lasts until the next row that ends it."""
    w = Window.partitionBy(by).orderBy(*order)
    x = df.withColumn("episode", F.count_if(ends).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(wanted)
    return x.withColumn("_k", F.row_number().over(Window.partitionBy(by, "episode").orderBy(*order))).where("_k = 1").drop("_k")


def due_slots(df: DataFrame, by: str, number: str, due: str) -> DataFrame:
    """(by, due, completed, missing, first_missing): which of the numbers 1..due are there."""
    done = df.where(F.col(number).between(F.lit(1), F.col(due))).select(by, number).distinct()
    done = done.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(number)))
    done = done.groupBy(by).agg(F.count("*").alias("completed"), F.min(F.when(F.col(number) != F.col("_k"), F.col("_k"))).alias("_hole"))
    x = df.groupBy(by).agg(F.max(due).alias("due")).join(done, by, "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    missing = F.col("due") - F.col("completed")
    first = F.coalesce(F.col("_hole").cast("long"), F.when(missing > 0, F.col("completed") + 1))
    return x.select(by, "due", "completed", missing.alias("missing"), first.alias("first_missing"))


def contributions(df: DataFrame, population: list[str], asset: str, outcome: str, base: Column, variant: Column) -> DataFrame:
    """What a variant's choices add to the mean outcome, by asset, and how concentrated the gains are."""
    delta = (variant.cast("int") - base.cast("int")) * F.col(outcome)
    each = df.groupBy(*population, asset).agg(F.sum(delta).alias("_d"), F.count("*").alias("_n"))
    w = Window.partitionBy(*population)  # a row for each asset
    x = each.withColumn("contribution", F.col("_d") / F.sum("_n").over(w))
    gain = F.when(F.col("contribution") > 0, F.col("contribution"))
    return x.withColumns({"positive_assets": F.count(gain).over(w), "concentration": F.max(gain).over(w) / F.sum(gain).over(w)}).drop("_d", "_n")


def micros_summary(micros: str = "micros") -> list[Column]:
    """Outcome metrics of one population in whole micros; null outcomes are missing."""
    x = F.col(micros)
    n, hits = F.count(x), F.count_if(x > 0)
    won, lost = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0)), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0))
    status = F.when(lost > 0, "FINITE").when(won > 0, "POSITIVE_INFINITY_NO_LOSSES").otherwise("UNDEFINED_NO_PROFIT_OR_LOSS")
    return [
        F.count("*").alias("population"), n.alias("evaluable"), (F.count("*") - n).alias("missing"), F.coalesce(F.sum(x), F.lit(0)).alias("total"), F.avg(x).alias("mean"), F.median(x).alias("median"),
        hits.alias("hits"), F.try_divide(hits, n).alias("hit_rate"), won.alias("gross_profit"), lost.alias("gross_loss"), F.try_divide(won, lost).alias("profit_factor"), status.alias("status"),
    ]


def on_panels(summary: DataFrame, panels: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """``summary`` with a row for each of the given panels, empty ones included; ``zero`` columns are 0 there."""
    return panels.join(summary, keys, "left").fillna(0, subset=zero)
