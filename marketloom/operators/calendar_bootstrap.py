"""Block bootstraps on a shared calendar of days: one schedule of draws for all groups, sums from prefix sums.

A resample costs its blocks, not its days, and groups that are compared see the
same days.  Totals are whole numbers (micros, counts), so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inference import draw


def schedule(spark: SparkSession, days: int, reps: int, block: int, circular: bool, seed: str = "7") -> DataFrame:
    """(rep, begin, size) of every block; the last block of a resample is what is left of the days.

    Circular blocks begin on any day and run on from the first day after the
    last; others begin where they fit.
    """
    if not 0 < block <= days:
        raise ValueError("block must be between 1 and days")
    blocks = -(-days // block)
    x = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    x = x.withColumn("size", F.least(F.lit(block), F.lit(days) - F.col("blk") * block))
    return x.select("rep", draw(F.lit(seed), F.col("rep"), F.col("blk"), F.lit(days) if circular else F.lit(days) - F.col("size") + 1).alias("begin"), "size")


def resampled(daily: DataFrame, by: list[str], day: str, totals: list[str], days: int, reps: int, block: int, circular: bool = True, seed: str = "7") -> DataFrame:
    """(by, rep, totals): each total over the resampled days; ``day`` counts from 0, days without rows are zero."""
    groups = daily.select(*by).distinct()
    span = 2 * days if circular else days
    grid = groups.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(span - 1))))
    summed = daily.groupBy(*by, F.col(day).cast("int").alias("_day")).agg(*(F.sum(c).cast("long").alias(c) for c in totals))
    grid = grid.withColumn("_day", F.col("_at") % days).join(summed, [*by, "_day"], "left").na.fill(0, totals)
    # one row a group and day of the calendar
    w = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.select(*by, "_at", *((F.sum(c).over(w)).alias(c) for c in totals), *((F.sum(c).over(w) - F.col(c)).alias(f"_before_{c}") for c in totals))
    plan = schedule(daily.sparkSession, days, reps, block, circular, seed).withColumn("_end", F.col("begin") + F.col("size") - 1)
    first = sums.select(*by, F.col("_at").alias("begin"), *(f"_before_{c}" for c in totals))
    last = sums.select(*by, F.col("_at").alias("_end"), *totals)
    x = plan.join(first, "begin").join(last, [*by, "_end"])
    return x.groupBy(*by, "rep").agg(*(F.sum(F.col(c) - F.col(f"_before_{c}")).alias(c) for c in totals))


def contrasts(draws: DataFrame, points: DataFrame, by: list[str], run: str, pairs: list[tuple[str, str, str | None]], top: str, bottom: str, alpha: float = 0.05) -> DataFrame:
    """Differences of ratios between runs under shared draws: (contrast, by, effect, low, high, simultaneous_low, simultaneous_high, positive).

    ``draws`` has (by, run, rep) with sums ``top`` and ``bottom``, ``points`` the
    same without rep.  A pair names a contrast, its upper and its lower run
    (None: zero); an empty bottom counts as ratio 0.  Bounds are percentiles; the
    simultaneous ones share ``alpha`` among all contrasts and groups (Bonferroni),
    one-sided below and two-sided above and below (``family_low``, ``family_high``).
    """
    ratio = F.when(F.col(bottom) != 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))

    def differences(x: DataFrame, keys: list[str]) -> DataFrame:
        wide = x.groupBy(*keys).agg(*(F.max(F.when(F.col(run) == name, ratio)).alias(f"_{i}") for i, name in enumerate(names)))
        return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("contrast"), (_at(names, up) - (_at(names, low) if low else F.lit(0.0))).alias("effect")) for n, up, low in pairs))))

    names = sorted({n for _, up, low in pairs for n in (up, low) if n})
    effects = differences(points, by)
    tests = effects.count()  # contrasts by groups
    each = alpha / max(tests, 1)
    cut = lambda q, name: F.percentile("effect", F.lit(q)).alias(name)
    spread = differences(draws, [*by, "rep"]).groupBy("contrast", *by).agg(
        cut(0.025, "low"), cut(0.975, "high"), cut(each, "simultaneous_low"), cut(each / 2, "family_low"), cut(1 - each / 2, "family_high"), (F.count_if(F.col("effect") > 0) / F.count("*")).alias("positive")
    )
    return effects.join(spread, ["contrast", *by])


def _at(names: list[str], name: str) -> Column:
    return F.coalesce(F.col(f"_{names.index(name)}"), F.lit(0.0))


def calendar_bounds(draws: DataFrame, points: DataFrame, by: list[str], top: str, bottom: str, alpha: float = 0.05) -> DataFrame:
    """(by, point, valid, invalid, lower, p_value) of the ratio ``top`` / ``bottom``.

    Resamples whose bottom is not positive are invalid.  lower is the one-sided
    basic bound 2 * point - q(1 - alpha); p_value the share of null-centred
    resamples that reach the point, one added to both counts, and 1 where the
    point is not positive.
    """
    ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
    x = draws.withColumn("_r", ratio).join(points.select(*by, ratio.alias("point")), by)
    reach = (F.count_if(F.col("_r") - F.col("point") >= F.col("point")) + 1) / (F.count("_r") + 1)
    p = F.when(F.first("point") <= 0, F.lit(1.0)).when(F.count("_r") > 0, reach)
    return x.groupBy(*by).agg(F.first("point").alias("point"), F.count("_r").alias("valid"), (F.count("*") - F.count("_r")).alias("invalid"), (2 * F.first("point") - F.percentile("_r", F.lit(1 - alpha))).alias("lower"), p.alias("p_value"))


def exact_endpoints(draws: DataFrame, by: list[str], top: str, bottom: str, levels: tuple[int, int] = (25, 975), least: int = 30) -> DataFrame:
    """(by, n, feasible, low_top, low_bottom, high_top, high_bottom): the endpoints as fractions of whole numbers, not as doubles.

    Fractions are put in order by cross-multiplied decimals through their
    quotient and remainder, so that equal ratios stay equal.  The lower endpoint
    is the floor of its place among the valid resamples, the upper the ceiling;
    levels are in thousandths.  feasible: ``empty`` without valid resamples,
    ``scarce`` under ``least`` of them, else ``ready``, and endpoints only then.
    """
    valid = draws.where(F.col(bottom) > 0)
    quotient = F.floor(F.col(top) / F.col(bottom).cast("decimal(20,0)")).cast("decimal(20,0)")
    rest = (F.col(top).cast("decimal(20,0)") - quotient * F.col(bottom).cast("decimal(20,0)")).cast("decimal(20,0)")
    order = F.struct(quotient.alias("q"), (rest.cast("decimal(20,0)") / F.col(bottom).cast("decimal(18,0)")).alias("r"), F.col("rep"))
    w = Window.partitionBy(*by)
    x = valid.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    place = lambda level, up: (F.ceil if up else F.floor)((F.col("_n") - 1) * level / 1000)
    pick = lambda level, up, c, name: F.max(F.when(F.col("_k") == place(level, up), F.col(c))).alias(name)
    found = x.groupBy(*by).agg(F.max("_n").alias("n"), pick(levels[0], False, top, "low_top"), pick(levels[0], False, bottom, "low_bottom"), pick(levels[1], True, top, "high_top"), pick(levels[1], True, bottom, "high_bottom"))
    out = draws.select(*by).distinct().join(found, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") == 0, "empty").when(F.col("n") < least, "scarce").otherwise("ready")
    return out.select(*by, "n", state.alias("feasible"), *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("low_top", "low_bottom", "high_top", "high_bottom")))
