"""Grouped metrics of outcomes and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import numbered


def trade_metrics(net: str = "net_return") -> list[Column]:
    """Count, sums, mean, median, win rate and profit factor of returns."""
    x = F.col(net)
    won, lost = F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))
    return [
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"),
        F.avg((x > 0).cast("int")).alias("win_rate"), F.try_divide(won, lost).alias("profit_factor"),
    ]


def grouped(df: DataFrame, sets: list[list[str]], columns: list[str], metrics: list[Column]) -> DataFrame:
    """Metrics of several different grouping lists in one pass; columns outside a list are null.

    As in SQL, the empty list has its row even where ``df`` has none.
    """
    x = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id(*columns).cast("long").alias("_set"), *metrics)
    if [] not in sets:
        return x.drop("_set")
    none = df.where(F.lit(False)).agg(*metrics)
    values = F.struct(*none.columns).alias("_values")
    nothing = none.select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns), F.lit(2 ** len(columns) - 1).cast("long").alias("_set"), F.lit(False).alias("_found"), values)
    both = x.select(*columns, "_set", F.lit(True).alias("_found"), values).unionByName(nothing)
    return both.groupBy(*columns, "_set").agg(F.max_by("_values", "_found").alias("_values")).select(*columns, "_values.*")


def drawdown(df: DataFrame, by: list[str], time: str, net: str) -> DataFrame:
    """Compound return and deepest drawdown of each series."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_eq", F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 + F.col(net)))).over(w)))
    x = x.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_eq").over(w)))
    return x.groupBy(*by).agg((F.max_by("_eq", time) - 1).alias("total_return"), F.min(F.col("_eq") / F.col("_peak") - 1).alias("max_drawdown"))


def most_open(df: DataFrame, by: list[str], entry: str, exit_: str) -> DataFrame:
    """Most positions open at once: running sum of entries and exits, exits first at equal times."""
    ends = df.select(*by, F.explode(F.array(F.struct(F.col(entry).alias("t"), F.lit(1).alias("d")), F.struct(F.col(exit_).alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.*")
    steps = ends.groupBy(*by, "t", "d").agg(F.sum("d").alias("s"))
    w = Window.partitionBy(*by).orderBy("t", "d")
    return steps.withColumn("open", F.sum("s").over(w)).groupBy(*by).agg(F.max("open").alias("most_open"))


def calendar(df: DataFrame, by: str, day: str, value: str, step: int) -> DataFrame:
    """A row for each group and day between the first and last, zero where nothing happened."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = df.select(by).distinct().crossJoin(ends).select(by, F.explode(F.sequence("a", "b", F.lit(step))).alias(day))  # groups by two numbers
    return grid.join(df.groupBy(by, day).agg(F.sum(value).alias(value)), [by, day], "left").fillna(0, [value])


def equal_count_bins(df: DataFrame, by: list[str], order: list[str], bins: int, name: str) -> DataFrame:
    """Adds ``name``: bin i holds rows [i*n/k, (i+1)*n/k) of its group in order.

    Rows are sorted by range over all tasks, so one group may hold any share of
    them; groups with nulls in ``by`` are groups of their own.  An empty table
    gives an empty one.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    x = numbered(df, order, "_place", by).alias("p").join(sizes.alias("s"), match)
    return x.select("p.*", F.floor((F.col("_place") * bins - 1) / F.col("_n")).cast("int").alias(name)).drop("_place")
