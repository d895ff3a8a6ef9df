"""Coverage and book accounting: sequences, interval unions, book state and depth walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_breaks(df: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """(by, n, breaks, lost) of a counter that should grow by one."""
    step = F.col(number) - F.lag(number).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_s", step).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_s") > 1).alias("breaks"), F.coalesce(F.sum(F.when(F.col("_s") > 1, F.col("_s") - 1)), F.lit(0)).alias("lost"))


def interval_union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, covered, longest_gap, islands) of the union of intervals."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.withColumn("_reach", reach).withColumn("_new", F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)))
    x = x.withColumn("_gap", F.when(F.col("_new"), F.col(start) - F.col("_reach"))).withColumn("_island", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = x.groupBy(*by, "_island").agg((F.max(end) - F.min(start)).alias("c"), F.max("_gap").alias("g"))
    return each.groupBy(*by).agg(F.sum("c").alias("covered"), F.coalesce(F.max("g"), F.lit(0)).alias("longest_gap"), F.count("*").alias("islands"))


def book(levels: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Last quantity of each side and price in update order; empty levels are gone."""
    latest = levels.groupBy(*by, "side", "price").agg(F.max_by("qty", F.struct(*order)).alias("qty"))
    return latest.where("qty > 0")


def walk(levels: DataFrame, by: list[str], quantity: float) -> DataFrame:
    """Mean price of buying ``quantity`` from the cheapest level up, and how much there was."""
    w = Window.partitionBy(*by).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("qty").over(w) - F.col("qty")
    x = levels.withColumn("take", F.greatest(F.lit(0.0), F.least(F.col("qty"), F.lit(quantity) - before)))
    return x.groupBy(*by).agg(F.sum("take").alias("filled"), F.try_divide(F.sum(F.col("take") * F.col("price")), F.sum("take")).alias("vwap"), F.count_if(F.col("take") > 0).alias("levels"))


def nearest_rank(value: str, q: float) -> F.Column:
    """Smallest value whose rank reaches q; counts of values are merged, no list of them is made."""
    return F.expr(f"percentile_disc({q}D) within group (order by `{value}`)")
