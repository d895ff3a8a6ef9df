"""Bootstrap, multiplicity, calibration and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walkforward import Schedule


def draw(seed: Column, rep: Column, block: Column, n: Column | int) -> Column:
    """A draw below ``n`` from a hash: the same in any order of tasks."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, rep, block)), 1, 8), 16, 10).cast("long") % n


def block_bootstrap_means(daily: DataFrame, by: str, place: str, total: str, count: str, reps: int, block: int, seed: str = "7") -> DataFrame:
    """Means of circular moving-block resamples: (by, rep, mean).

    ``daily`` has one row per group and day, days numbered from 0.  All groups
    share one draw schedule.  A block is one difference of running sums over
    the days and their repetition, so a resample costs its blocks, not its days.
    """
    days = daily.groupBy(by).agg(F.count("*").alias("days"))
    doubled = daily.join(days, by).select(by, "days", F.explode(F.array(F.col(place), F.col(place) + F.col("days"))).alias("at"), total, count)
    w = Window.partitionBy(by).orderBy("at")
    sums = doubled.withColumns({"st": F.sum(total).over(w), "sc": F.sum(count).over(w)}).select(by, "at", "st", "sc", (F.col("st") - F.col(total)).alias("bt"), (F.col("sc") - F.col(count)).alias("bc"))
    spark = daily.sparkSession
    plan = days.join(spark.range(reps).withColumnRenamed("id", "rep"), how="cross")  # groups by a parameter
    plan = plan.withColumn("blk", F.explode(F.expr(f"sequence(0L, (days + {block - 1}) div {block} - 1)")))
    plan = plan.withColumn("begin", draw(F.lit(seed), F.col("rep"), F.col("blk"), F.col("days"))).withColumn("size", F.least(F.lit(block), F.col("days") - F.col("blk") * block))
    a = sums.select(by, F.col("at").alias("begin"), "bt", "bc")
    b = sums.select(by, F.col("at").alias("finish"), "st", "sc")
    x = plan.withColumn("finish", F.col("begin") + F.col("size") - 1).join(a, [by, "begin"]).join(b, [by, "finish"])
    return x.groupBy(by, "rep").agg(F.try_divide(F.sum(F.col("st") - F.col("bt")), F.sum(F.col("sc") - F.col("bc"))).alias("mean"))


def intervals(means: DataFrame, by: str, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    return means.groupBy(by).agg(*(F.percentile("mean", F.lit(q)).alias(n) for q, n in zip(levels, ("low", "high"), strict=True)), F.count_if(F.col("mean") <= 0).alias("n_below"))


def holm(df: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values over the whole (small) family of hypotheses."""
    order = Window.orderBy(p, name)
    w = Window.partitionBy()
    k = F.row_number().over(order)
    x = df.withColumn("_raw", F.least(F.lit(1.0), (F.count("*").over(w) - k + 1) * F.col(p))).withColumn("adjusted", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("rejected", F.col("adjusted") <= alpha).drop("_raw")


def naive_bayes(train: DataFrame, label: str, numeric: list[str], categorical: list[str], laplace: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Moments by class, and Laplace-smoothed log probabilities by class, feature and value."""
    moments = train.groupBy(label).agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in numeric for k, f in (("mean", F.avg), ("var", F.var_pop))))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in categorical))).alias("x")
    counts = train.select(label, pairs).groupBy(label, "x.feature", "x.value").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("feature").agg(F.count_distinct("value").alias("values"))
    classes = train.groupBy(label).agg(F.count("*").alias("n"))
    probabilities = counts.join(sizes, "feature").join(classes, label)
    return moments, probabilities.select(label, "feature", "value", F.log((F.col("c") + laplace) / (F.col("n") + laplace * F.col("values"))).alias("log_p"))


def walk_forward_folds(df: DataFrame, time: str, first_train_ms: int, test_ms: int, embargo_ms: int) -> DataFrame:
    """Rows by expanding fold: role train (up to the embargo) or test.

    A row comes once for every fold that it trains; where sums or counts of the
    folds are enough, ``walkforward`` has them without such copies.
    """
    schedule = Schedule.of(df, time, first_train_ms, test_ms, embargo_ms)
    slot, test = schedule.slot(time), schedule.test(time)
    role = lambda fold, name: F.struct(fold.alias("fold"), F.lit(name).alias("role"))
    trains = F.when(slot < schedule.folds, F.transform(F.sequence(slot, F.lit(schedule.folds - 1)), lambda k: role(k, "train"))).otherwise(F.array().cast("array<struct<fold: int, role: string>>"))
    tests = F.when(test.isNotNull(), F.array(role(test, "test"))).otherwise(F.array().cast("array<struct<fold: int, role: string>>"))
    return df.select("*", F.inline(F.concat(trains, tests)))
