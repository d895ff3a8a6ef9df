"""Evidence on series and predictions: robust scores, empirical distributions, calibration, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written
from .inference import draw
from .metrics import equal_count_bins
from .series import full, last, prior, segment


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def robust_z(df: DataFrame, column: str, n: int) -> DataFrame:
    """Adds ``z``, against median and scaled MAD of exactly ``n`` strictly earlier rows, and ``z_status``."""
    x = df.withColumn("_past", F.array_sort(F.collect_list(column).over(prior(n))))
    x = x.withColumn("_median", _middle(F.col("_past")))
    x = x.withColumn("_mad", _middle(F.array_sort(F.transform("_past", lambda v: F.abs(v - F.col("_median"))))))
    status = F.when(F.size("_past") < n, "WARMUP").when(F.col("_mad") <= 0, "ZERO_SCALE").otherwise("OK")
    x = x.withColumn("z_status", status)
    return x.withColumn("z", F.when(F.col("z_status") == "OK", (F.col(column) - F.col("_median")) / (F.col("_mad") * 1.4826))).drop("_past", "_median", "_mad")


def prior_ecdf(column: str, n: int) -> Column:
    """Share of ``n`` strictly earlier rows that are not above this one; null with fewer."""
    past = F.collect_list(column).over(prior(n))
    return F.when(F.size(past) == n, F.size(F.filter(past, lambda v: v <= F.col(column))) / F.lit(float(n)))


def taker_delta(n: int) -> Column:
    """Signed taker quote over quote volume of ``n`` bars; null with fewer bars or no volume."""
    volume = F.sum("quote_volume").over(last(n))
    return full(F.when(volume > 0, F.sum(2 * F.col("taker_quote") - F.col("quote_volume")).over(last(n)) / volume), last(n), n)


def realized_volatility(df: DataFrame, n: int) -> DataFrame:
    """Adds ``volatility_bps``: root of the summed squares of ``n`` log returns."""
    x = df.withColumn("_r2", F.pow(F.log(F.col("close") / F.lag("close").over(segment())), F.lit(2.0)))
    return x.withColumn("volatility_bps", F.when(F.count("_r2").over(last(n)) == n, 10000 * F.sqrt(F.sum("_r2").over(last(n))))).drop("_r2")


def duration_quantile(df: DataFrame, by: str, time: str, value: str, q: float) -> DataFrame:
    """(by, quantile): the smallest value at or below which a key spends ``q`` of its time."""
    x = df.withColumn("_d", F.lead(time).over(Window.partitionBy(by).orderBy(time)) - F.col(time)).where("_d > 0")
    each = x.groupBy(by, value).agg(F.sum("_d").alias("_d"))
    upto = F.sum("_d").over(Window.partitionBy(by).orderBy(value))
    each = each.withColumns({"_upto": upto, "_all": F.sum("_d").over(Window.partitionBy(by))})
    return each.where(F.col("_upto") >= F.col("_all") * q).groupBy(by).agg(F.min(value).alias("quantile"))


def development_midrank(df: DataFrame, by: str, value: str, fitted: str) -> Column:
    """Mid-rank of ``value`` among the rows marked ``fitted``; rows of any kind are ranked, only those count."""
    one = F.col(fitted).cast("long")
    upto = F.sum(one).over(Window.partitionBy(by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    equal = F.sum(one).over(Window.partitionBy(by, value))
    return F.try_divide(2 * upto - equal, 2 * F.sum(one).over(Window.partitionBy(by)))


def probability(logit: Column, temperature: Column | float = 1.0, intercept: Column | float = 0.0) -> Column:
    p = 1 / (1 + F.exp(-(logit / temperature + intercept)))
    return F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))


def log_loss(p: Column, label: Column) -> Column:
    return -F.log(F.when(label == 1, p).otherwise(1 - p))


def fit_sigmoid(df: DataFrame, by: list[str], logit: str, label: str, temperatures: list[float], intercepts: list[float]) -> DataFrame:
    """(by, temperature, intercept, loss): the grid point of least mean log loss; ties to the smaller values.

    The grid is a parameter, so each row is scored at a fixed number of points.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("temperature"), F.lit(b).alias("intercept")) for t in temperatures for b in intercepts))).alias("_grid")
    x = df.select(*by, logit, label, grid)
    loss = log_loss(probability(F.col(logit), F.col("_grid.temperature"), F.col("_grid.intercept")), F.col(label))
    x = x.groupBy(*by, "_grid.temperature", "_grid.intercept").agg(F.round(F.avg(loss), 9).alias("loss"))
    best = F.min(F.struct("loss", "temperature", "intercept")).alias("b")
    return x.groupBy(*by).agg(best).select(*by, "b.temperature", "b.intercept", "b.loss")


def calibration(df: DataFrame, by: list[str], p: str, label: str, order: list[str], bins: int = 10) -> DataFrame:
    """(by, n, loss, brier, ece) with bins of equal count."""
    x = equal_count_bins(df, by, [p, *order], bins, "_bin")
    each = x.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.sum(log_loss(F.col(p), F.col(label))).alias("_l"), F.sum(F.pow(F.col(p) - F.col(label), F.lit(2.0))).alias("_s"), F.abs(F.sum(F.col(p)) - F.sum(label)).alias("_e"))
    n = F.sum("_n")
    return each.groupBy(*by).agg(n.alias("n"), (F.sum("_l") / n).alias("loss"), (F.sum("_s") / n).alias("brier"), (F.sum("_e") / n).alias("ece"))


#: Ranges of the hash by which draws are counted, for each draw and stratum.
RANGES = 4096


def matched_random(df: DataFrame, stratum: str, id_: str, chosen: str, value: str, reps: int) -> DataFrame:
    """(rep, picked, random_mean): draws without replacement of as many rows of each stratum as are ``chosen``.

    The rows of smallest hash are drawn.  Counts and sums by range of the hash
    tell in which range a draw ends; only rows of that range are sorted.  Values
    are added as whole ten-thousandths and what is left, in any order alike.
    """
    wanted = df.groupBy(stratum).agg(F.count_if(chosen).alias("_want")).where("_want > 0")
    x = df.select(stratum, id_, value).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    x = x.withColumn("_key", draw(F.lit("11"), F.col("rep"), F.col(id_), 1 << 32)).withColumn("_range", F.floor(F.col("_key") / ((1 << 32) // RANGES)))
    units = F.when(F.abs(value) < 1e12, F.round(F.col(value) * 10000)).otherwise(F.lit(0.0)).cast("long")
    sums = [F.count("*").alias("_n"), F.count(value).alias("_values"), F.sum(F.when(F.col(value).isNotNull(), units)).alias("_units"), F.sum(F.col(value) - units / 10000.0).alias("_rest")]
    ranges = written(x.groupBy("rep", stratum, "_range").agg(*sums).join(wanted, stratum))
    upto = F.sum("_n").over(Window.partitionBy("rep", stratum).orderBy(F.asc_nulls_first("_range")))
    ranges = ranges.withColumn("_left", F.col("_want") - upto + F.col("_n")).where("_left > 0")
    cut = ranges.where("_left < _n").select("rep", stratum, "_range", "_left")
    same = F.col("x.rep").eqNullSafe(F.col("c.rep")) & (F.col(f"x.{stratum}") == F.col(f"c.{stratum}")) & F.col("x._range").eqNullSafe(F.col("c._range"))
    rows = x.alias("x").join(F.broadcast(cut).alias("c"), same).select("x.*", "c._left")
    place = F.row_number().over(Window.partitionBy("rep", stratum).orderBy("_key", id_))
    rows = rows.withColumn("_place", place).where("_place <= _left").groupBy("rep").agg(*sums)
    both = ranges.where("_left >= _n").select("rep", "_n", "_values", "_units", "_rest").unionByName(rows)
    mean = F.try_divide(F.sum("_units") / 10000.0 + F.sum("_rest"), F.sum("_values"))
    return both.groupBy("rep").agg(F.sum("_n").alias("picked"), mean.alias("random_mean"))


def verdicts(df: DataFrame, by: list[str], criteria: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(by, criterion, value, op, threshold, passed): each criterion is (column, '>=' or '<=', threshold); null fails."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), F.col(c).cast("double").alias("value"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold")) for n, (c, op, t) in criteria.items()))).alias("x")
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return df.select(*by, rows).select(*by, "x.*").withColumn("passed", F.coalesce(passed, F.lit(False)))
