"""Walk-forward folds by arithmetic and prefix sums: no row is repeated for a fold, and no row meets a table of folds.

A row trains every fold from its slot on, so what a fold learns is a running
sum over slots of what the rows of each slot add up to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written

RIDGE_LAMBDA = 1.0
LOGISTIC_LAMBDA = 1.0
TOLERANCE = 1e-10
MAX_ITERATIONS = 50


@dataclass(frozen=True)
class Schedule:
    """Expanding folds: fold k tests [start + k * test_ms, ...) and trains on what lies before that by more than the embargo."""

    start: int
    test_ms: int
    embargo_ms: int
    folds: int

    @classmethod
    def of(cls, rows: DataFrame, time: str, first_train_ms: int, test_ms: int, embargo_ms: int) -> Schedule:
        low, high = rows.agg(F.min(time), F.max(time)).first()
        if low is None or high < low + first_train_ms:
            return cls(0, test_ms, embargo_ms, 0)
        return cls(low + first_train_ms, test_ms, embargo_ms, (high - low - first_train_ms) // test_ms + 1)

    def slot(self, time: str) -> Column:
        """The first fold that a row trains."""
        return F.greatest(F.lit(0), F.floor((F.col(time) + self.embargo_ms - self.start) / self.test_ms) + 1).cast("int")

    def test(self, time: str) -> Column:
        """The fold that a row tests, or null."""
        return F.when(F.col(time) >= self.start, F.floor((F.col(time) - self.start) / self.test_ms)).cast("int")


def _grid(groups: DataFrame, schedule: Schedule) -> DataFrame:
    """Each group once for every fold."""
    folds = F.sequence(F.lit(0), F.lit(schedule.folds - 1)) if schedule.folds else F.array().cast("array<int>")
    return groups.withColumn("fold", F.explode(folds))


def fold_counts(rows: DataFrame, by: list[str], time: str, schedule: Schedule) -> DataFrame:
    """(fold, by, train, test): rows of each group that train and test each fold."""
    x = rows.select(*by, schedule.slot(time).alias("_slot"), schedule.test(time).alias("_test"))
    trains = x.groupBy(*by, F.col("_slot").alias("fold")).agg(F.count("*").alias("_new"))
    tests = x.where("_test is not null").groupBy(*by, F.col("_test").alias("fold")).agg(F.count("*").alias("test"))
    grid = _grid(rows.select(*by).distinct(), schedule).join(trains, [*by, "fold"], "left").join(tests, [*by, "fold"], "left")
    upto = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("fold", *by, F.coalesce(F.sum("_new").over(upto), F.lit(0)).alias("train"), F.coalesce("test", F.lit(0)).alias("test"))


def train_moments(rows: DataFrame, value: str, time: str, schedule: Schedule) -> DataFrame:
    """(fold, mean, scale) over each fold's training rows; scale is the population deviation, or 1 without spread.

    Sums are of distances from the mean of all rows, which keeps their digits.
    """
    middle = rows.agg(F.avg(value)).first()[0] or 0.0
    away = F.col(value) - F.lit(middle)
    each = rows.where(F.col(value).isNotNull()).groupBy(schedule.slot(time).alias("fold")).agg(F.count("*").alias("n"), F.sum(away).alias("s"), F.sum(away * away).alias("q"))
    one = rows.sparkSession.range(1).select(F.lit(0).alias("_one"))
    # one row a fold: the folds of a schedule are few
    upto = Window.partitionBy("_one").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    x = _grid(one, schedule).join(each, "fold", "left")
    x = x.select("fold", *(F.sum(c).over(upto).alias(c) for c in ("n", "s", "q"))).where("n > 0")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))
    return x.select("fold", (F.lit(middle) + F.col("s") / F.col("n")).alias("mean"), F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("scale"))


@dataclass(frozen=True)
class Models:
    """Models of each fold over [1, standardised features, one-hot of the assets]."""

    schedule: Schedule
    features: list[str]
    assets: list[str]
    means: np.ndarray
    scales: np.ndarray
    ridge: np.ndarray
    logistic: np.ndarray
    iterations: int


def _matrix(batch: pa.RecordBatch, features: list[str], assets: list[str], asset: str) -> np.ndarray:
    """[1, features, one-hot] of a batch."""
    names = batch.column(asset).to_pylist()
    hot = np.array([[n == a for a in assets] for n in names], float).reshape(len(names), len(assets))
    return np.column_stack([np.ones(len(names)), *(batch.column(f).to_numpy(zero_copy_only=False) for f in features), hot])


def _summed(rows: DataFrame, per_batch, folds: int) -> np.ndarray:
    """The sum over all batches of ``per_batch`` (folds x k values), added up fold by fold in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = per_batch(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["fold", "v"])

    parts = rows.mapInArrow(run, "fold int, v array<double>").select("fold", F.posexplode("v").alias("i", "x"))
    # one row a task, fold and value; folds and dimensions are bounded by the schedule and the features
    sums = parts.groupBy("fold", "i").agg(F.sum("x").alias("x")).groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return np.array([[x["x"] for x in r["v"]] for r in sorted(sums.collect(), key=lambda r: r["fold"])])


def fit_folds(rows: DataFrame, time: str, features: list[str], asset: str, target: str, positive: str, schedule: Schedule, ridge_lambda: float = RIDGE_LAMBDA, logistic_lambda: float = LOGISTIC_LAMBDA, tolerance: float = TOLERANCE) -> Models:
    """Ridge regression of ``target`` and L2-logistic regression of ``positive`` for every fold.

    Features are standardised by the fold's training rows; assets are one-hot and
    not centred, one that a fold has not seen has no weight; the intercept is
    not penalised.  Ridge needs one pass, its Gram matrix being a sum over slots;
    each Newton step of the logistic fits is one pass for all folds together.
    Rows with nulls in any of the columns are left out.  The driver holds folds
    times squared dimensions, never rows.
    """
    folds = schedule.folds
    names = [*features, asset, target, positive]
    x = rows.where(" and ".join(f"`{c}` is not null" for c in names)).select(*names, schedule.slot(time).alias("slot")).where(F.col("slot") < folds)
    x = written(x.withColumn(positive, F.col(positive).cast("double")))
    assets = sorted(r[0] for r in x.select(asset).distinct().collect())
    d = 1 + len(features) + len(assets)
    k = len(features)

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        m = np.column_stack([_matrix(batch, features, assets, asset), batch.column(target).to_numpy(zero_copy_only=False)])
        slot = batch.column("slot").to_numpy()
        out = np.zeros((folds, (d + 1) ** 2))
        for s in np.unique(slot):
            own = m[slot == s]
            out[s] = (own.T @ own).ravel()
        return out

    grams = np.cumsum(_summed(x, gram, folds), axis=0).reshape(folds, d + 1, d + 1)
    n = grams[:, 0, 0]
    means = grams[:, 0, 1 : k + 1] / n[:, None]
    diagonal = np.einsum("fii->fi", grams)[:, 1 : k + 1] / n[:, None]
    scales = np.sqrt(np.maximum(diagonal - means**2, 0))
    scales[~(scales > 1e-12 * np.maximum(1, np.abs(means)))] = 1.0

    # raw columns to standardised ones, as a matrix, so that no second pass over the rows is needed
    change = np.tile(np.eye(d), (folds, 1, 1))
    for j in range(k):
        change[:, 1 + j, 1 + j] = 1 / scales[:, j]
        change[:, 0, 1 + j] = -means[:, j] / scales[:, j]
    seen = grams[:, 0, k + 1 : d] > 0
    inner = np.swapaxes(change, 1, 2) @ grams[:, :d, :d] @ change
    right = np.einsum("fji,fj->fi", change, grams[:, :d, d])
    penalty = np.diag([0.0] + [1.0] * (d - 1))
    ridge = np.linalg.solve(inner + ridge_lambda * penalty, right[..., None])[..., 0]
    ridge[:, k + 1 :][~seen] = 0.0

    def newton(beta: np.ndarray):
        def run(batch: pa.RecordBatch) -> np.ndarray:
            raw = _matrix(batch, features, assets, asset)
            y = batch.column(positive).to_numpy(zero_copy_only=False)
            slot = batch.column("slot").to_numpy()
            out = np.zeros((folds, 1 + d + d * d))
            for f in range(int(slot.min()), folds):
                mine = slot <= f
                m, t = raw[mine] @ change[f], y[mine]
                z = m @ beta[f]
                p = 1 / (1 + np.exp(-z))
                loss = np.logaddexp(0, z).sum() - t @ z
                out[f] = np.concatenate([[loss], m.T @ (t - p), ((m * (p * (1 - p))[:, None]).T @ m).ravel()])
            return out

        return _summed(x, run, folds)

    share = np.clip(np.cumsum(_summed(x, lambda b: _positives(b, positive, folds), folds)[:, 0]) / n, 1e-9, 1 - 1e-9)
    beta = np.zeros((folds, d))
    beta[:, 0] = np.log(share / (1 - share))
    step = np.ones(folds)
    best, base, delta = np.full(folds, np.inf), beta.copy(), np.zeros((folds, d))
    for iteration in range(1, MAX_ITERATIONS + 1):
        found = newton(beta)
        objective = found[:, 0] + logistic_lambda / 2 * (beta[:, 1:] ** 2).sum(1)
        worse = objective > best + 1e-12 * np.abs(best)
        # folds whose step went too far take half of it, the others go on from where they are
        better = ~worse
        base[better], best[better], step[better] = beta[better], objective[better], 1.0
        g = found[:, 1 : d + 1] - logistic_lambda * beta * np.diag(penalty)
        h = found[:, d + 1 :].reshape(folds, d, d) + logistic_lambda * penalty
        delta[better] = np.linalg.solve(h[better], g[better][..., None])[..., 0]
        step[worse] /= 2
        if better.all() and np.abs(delta).max() <= tolerance:
            break
        beta = base + step[:, None] * delta
    else:
        raise RuntimeError("the logistic fits did not converge")
    base[:, k + 1 :][~seen] = 0.0
    return Models(schedule, features, assets, means, scales, ridge, base, iteration)


def _positives(batch: pa.RecordBatch, positive: str, folds: int) -> np.ndarray:
    return np.bincount(batch.column("slot").to_numpy(), batch.column(positive).to_numpy(zero_copy_only=False), folds)[:, None]


def predicted(rows: DataFrame, models: Models, time: str, asset: str, gate: float = 0.0, gate_probability: float = 0.5) -> DataFrame:
    """The test rows of each fold with fold, expected (ridge), probability (logistic), unseen_asset, and selected where both pass their gates."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(f, models.means[f].tolist(), models.scales[f].tolist(), models.ridge[f].tolist(), models.logistic[f].tolist()) for f in range(models.schedule.folds)],
        "fold int, means array<double>, scales array<double>, ridge array<double>, logistic array<double>",
    )
    k = len(models.features)

    def score(weights: str) -> Column:
        value = F.get(weights, F.lit(0))
        for j, name in enumerate(models.features):
            value = value + F.get(weights, F.lit(1 + j)) * (F.col(name) - F.get("means", F.lit(j))) / F.get("scales", F.lit(j))
        hot = F.lit(0.0)
        for j, name in enumerate(models.assets):
            hot = F.when(F.col(asset) == name, F.get(weights, F.lit(1 + k + j))).otherwise(hot)
        return value + hot

    x = rows.withColumn("fold", models.schedule.test(time)).where("fold is not null").join(F.broadcast(table), "fold")  # one row a fold
    unseen = F.lit(True)
    for j, name in enumerate(models.assets):
        unseen = F.when(F.col(asset) == name, F.get("ridge", F.lit(1 + k + j)) == 0).otherwise(unseen)
    x = x.withColumns({"expected": score("ridge"), "probability": 1 / (1 + F.exp(-score("logistic"))), "unseen_asset": unseen})
    return x.withColumn("selected", (F.col("expected") > gate) & (F.col("probability") > gate_probability)).drop("means", "scales", "ridge", "logistic")


def monthly_expectations(rows: DataFrame, market: str, cohort: str, time: str, value: str, margin: float, horizon_ms: int, calibration_months: int, minimum: int) -> DataFrame:
    """Expected ``value`` by fold, market, cohort and class (value over ``margin`` or not), with the sizes of each fold.

    A fold tests one calendar month (UTC).  Before it lie ``calibration_months``,
    and all earlier months train.  Rows whose horizon reaches the next part are
    purged, and so are rows of calibration and test that begin within a horizon
    of their start; the horizon is shorter than half a month.  Sums of months
    add up over time, and what is purged is subtracted, so no row is joined with
    folds.  A cohort with fewer than ``minimum`` rows of a class takes the mean
    of its market.  Folds begin with the first that has training rows of both
    classes in its market.  Returns fold (first day of the month), market,
    cohort, target, n, expected, from_market, train, calibration and test.
    """
    month = lambda c: F.trunc(F.timestamp_millis(c).cast("date"), "month")
    start = lambda m: F.unix_millis(m.cast("timestamp"))
    x = rows.select(F.col(market).alias("market"), F.col(cohort).alias("cohort"), F.col(value).alias("v"), month(F.col(time)).alias("m"), F.col(time).alias("t")).where("v is not null")
    x = x.withColumns({"target": F.col("v") > margin, "tail": F.col("t") + horizon_ms >= start(F.add_months("m", 1)), "head": F.col("t") < start(F.col("m")) + horizon_ms})
    by = ["market", "cohort", "target"]
    part = lambda flag, what: F.sum(F.when(F.col(flag), what).otherwise(F.lit(0)))
    each = x.groupBy(*by, "m").agg(F.count("*").alias("n"), F.sum("v").alias("s"), part("tail", F.lit(1)).alias("n_tail"), part("tail", F.col("v")).alias("s_tail"), part("head", F.lit(1)).alias("n_head"))
    each = written(each)
    low, high = each.agg(F.min("m"), F.max("m")).first()
    if low is None:
        months = F.array().cast("array<date>")
    else:
        months = F.sequence(F.lit(low), F.lit(high), F.expr("interval 1 month"))
    # groups of market, cohort and class, once for each month
    grid = each.select(*by).distinct().withColumn("m", F.explode(months)).join(each, [*by, "m"], "left")
    grid = grid.na.fill(0, ["n", "s", "n_tail", "s_tail", "n_head"])
    w = Window.partitionBy(*by).orderBy("m")
    c = calibration_months
    before = w.rowsBetween(Window.unboundedPreceding, -c - 1)
    last_train = lambda col: F.coalesce(F.lag(col, c + 1).over(w), F.lit(0))
    calibration = F.coalesce(F.sum("n").over(w.rowsBetween(-c, -1)), F.lit(0)) - F.coalesce(F.lag("n_head", c).over(w), F.lit(0)) - F.coalesce(F.lag("n_tail", 1).over(w), F.lit(0))
    grid = grid.select(
        *by, F.col("m").alias("fold"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - last_train("n_tail")).alias("n_train"), (F.coalesce(F.sum("s").over(before), F.lit(0.0)) - last_train("s_tail")).alias("s_train"),
        calibration.alias("n_cal"), (F.col("n") - F.col("n_head") - F.col("n_tail")).alias("n_test"),
    )
    of_market, of_class = Window.partitionBy("market", "fold"), Window.partitionBy("market", "fold", "target")
    grid = grid.withColumns({"train": F.sum("n_train").over(of_market), "calibration": F.sum("n_cal").over(of_market), "test": F.sum("n_test").over(of_market), "class_n": F.sum("n_train").over(of_class), "class_s": F.sum("s_train").over(of_class)})
    grid = grid.withColumn("least", F.min(F.col("class_n")).over(of_market)).withColumn("classes", F.size(F.collect_set("target").over(of_market)))
    enough = F.col("n_train") >= minimum
    expected = F.when(enough, F.col("s_train") / F.col("n_train")).otherwise(F.col("class_s") / F.col("class_n"))
    return grid.where("least > 0 and classes = 2").select("fold", *by, F.col("n_train").alias("n"), expected.alias("expected"), (~enough).alias("from_market"), "train", "calibration", "test")
