"""Audits of tables: grids, schedules, conflicts, integrity rules, censuses and lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_violations(df: DataFrame, by: str, time: str, step_ms: int) -> DataFrame:
    """(by, n, unordered, off_grid): times that repeat, and steps that are no multiple of ``step_ms``."""
    x = df.withColumn("_g", F.col(time) - F.lag(time).over(Window.partitionBy(by).orderBy(time)))
    return x.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("_g") <= 0).alias("unordered"), F.count_if(F.col("_g") % step_ms != 0).alias("off_grid"))


def schedule_coverage(df: DataFrame, by: str, time: str, step_ms: int) -> DataFrame:
    """(by, n, first_ms, last_ms, off_grid, wrong_spacing) of a schedule that should tick every ``step_ms``."""
    x = df.withColumn("_g", F.col(time) - F.lag(time).over(Window.partitionBy(by).orderBy(time)))
    return x.groupBy(by).agg(F.count("*").alias("n"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.count_if(F.col(time) % step_ms != 0).alias("off_grid"), F.count_if(F.col("_g") != step_ms).alias("wrong_spacing"))


def cursor_conflicts(df: DataFrame, by: str, cursor: str, content: list[str]) -> DataFrame:
    """(by, cursors, conflicts, latest): cursors that stand for more than one content, and the newest cursor."""
    each = df.groupBy(by, cursor).agg(F.count_distinct(F.struct(*content)).alias("_k"))
    return each.groupBy(by).agg(F.count("*").alias("cursors"), F.count_if(F.col("_k") > 1).alias("conflicts"), F.max(cursor).alias("latest"))


def failures(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(rule, key) of every row and rule that it breaks; all rules in one pass.  A null condition breaks nothing."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), *key)


def failures_by_key(df: DataFrame, rules: dict[str, Column], key: list[str], repeated: str) -> DataFrame:
    """(rule, key, n): rows of each key that break each rule, and those of keys with several rows as rule ``repeated``.

    One aggregation by key, so that no rows are held or sorted for it.
    """
    rows = F.count("*")
    counts = {repeated: F.when(rows > 1, rows).otherwise(0)} | {n: F.count_if(c) for n, c in rules.items()}
    x = df.groupBy(*key).agg(F.array(*(F.struct(F.lit(r).alias("rule"), n.alias("n")) for r, n in counts.items())).alias("_x"))
    return x.select(F.explode("_x").alias("_x"), *key).where("_x.n > 0").select("_x.rule", *key, "_x.n")


def census(df: DataFrame, kinds: dict[str, Column], time: str) -> DataFrame:
    """(kind, key, n, first, last): how often each value of each kind occurs, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()))).alias("x")
    return df.select(pairs, time).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def missing_slots(df: DataFrame, by: str, time: str, step_ms: int) -> DataFrame:
    """(by, time) of the grid slots between a key's first and last row that no row fills."""
    slots = df.select(by, (F.col(time) - F.col(time) % step_ms).alias(time)).distinct()
    after = F.lead(time).over(Window.partitionBy(by).orderBy(time))
    holes = slots.withColumn("_after", after).where(F.col("_after") - F.col(time) > step_ms)
    return holes.select(by, F.explode(F.sequence(F.col(time) + step_ms, F.col("_after") - step_ms, F.lit(step_ms))).alias(time))


def transitions(df: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """(before, after, n): how often a key's state follows another."""
    x = df.select(F.lag(state).over(Window.partitionBy(by).orderBy(*order)).alias("before"), F.col(state).alias("after"))
    return x.where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


def coverage_time(df: DataFrame, by: str, time: str, category: str, stale_ms: int, order: tuple[str, ...] = ()) -> DataFrame:
    """(by, category, covered_ms, longest_ms): time in each category; a state counts for ``stale_ms`` and is stale after that.

    The last state of a key lasts for no time.  Of states of one time the last by ``order`` counts.
    """
    x = df.withColumn("_d", F.lead(time).over(Window.partitionBy(by).orderBy(time, *order)) - F.col(time)).where("_d > 0")
    parts = F.array(F.struct(F.col(category).alias("category"), F.least(F.col("_d"), F.lit(stale_ms)).alias("ms")), F.struct(F.lit("stale").alias("category"), (F.col("_d") - stale_ms).alias("ms")))
    return x.select(by, F.explode(parts).alias("x")).where("x.ms > 0").groupBy(by, "x.category").agg(F.sum("x.ms").alias("covered_ms"), F.max("x.ms").alias("longest_ms"))


def clock_residuals(df: DataFrame, by: str, order: list[str], wall_ms: str, monotonic_ns: str, small_ms: int = 2, large_ms: int = 100) -> DataFrame:
    """(by, class, n): how far steps of the wall clock are from those of the monotonic clock."""
    w = Window.partitionBy(by).orderBy(*order)
    off = F.abs((F.col(wall_ms) - F.lag(wall_ms).over(w)) * 1_000_000 - (F.col(monotonic_ns) - F.lag(monotonic_ns).over(w)))
    x = df.select(by, off.alias("_o")).where("_o is not null")
    kind = F.when(F.col("_o") <= small_ms * 1_000_000, "steady").when(F.col("_o") <= large_ms * 1_000_000, "slewed").otherwise("stepped")
    return x.groupBy(by, kind.alias("class")).agg(F.count("*").alias("n"))
