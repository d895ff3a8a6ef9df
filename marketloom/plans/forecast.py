"""Registered queries of walk-forward models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series, walkforward
from .market import _OFF_TIES, _register, rounded
from .views import DAY_MS, PRINTS, candles, prints


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of each bar three features, and the next bar's return in basis points."""
    x = series.with_segments(candles(spark, d), DAY_MS)
    w = series.segment()
    before, after = F.lag("close").over(w), F.lead("close").over(w)
    x = x.withColumns({"change": F.log(F.col("close") / before), "taker": F.col("taker_quote") / F.col("quote_volume"), "size": F.log(F.col("volume")), "next_bps": 10_000 * F.log(after / F.col("close"))})
    return x.withColumn("up", F.col("next_bps") > 0).where("change is not null and next_bps is not null").select("symbol", "open_time_ms", "change", "taker", "size", "next_bps", "up")


FEATURES = ["change", "taker", "size"]


@_register("b19_walk_forward_models")
def b19(spark, d):
    """Test rows with what the models of their fold expect; the fits are held against NumPy in the tests."""
    rows = model_rows(spark, d)
    schedule = walkforward.Schedule.of(rows, "open_time_ms", 180 * DAY_MS, 30 * DAY_MS, DAY_MS // 4)
    models = walkforward.fit_folds(rows, "open_time_ms", FEATURES, "symbol", "next_bps", "up", schedule)
    found = walkforward.predicted(rows, models, "open_time_ms", "symbol")
    return rounded(found.select("fold", "symbol", "open_time_ms", "next_bps", "expected", "probability", "unseen_asset", "selected"))


_MS = lambda c: f"epoch_ms(cast({c} as timestamp))"
_HORIZON = 3 * DAY_MS


@_register(
    "b16_monthly_walk_forward",
    f"""with {PRINTS}, x as (select case when is_buyer_maker then 'maker' else 'taker' end as market, symbol as cohort, ts_ms as t, cast(drift - spread as double) as v, drift - spread > 1 as target from prints),
 folds as (select unnest(generate_series(date_trunc('month', make_timestamp(min(t) * 1000)), date_trunc('month', make_timestamp(max(t) * 1000)), interval 1 month)) as m from x),
 spans as (select cast(m as date) as fold, {_MS('m')} as a, {_MS('m + interval 1 month')} as b, {_MS('m - interval 2 month')} as c from folds),
 parts as (select fold, market, cohort, target, v, t + {_HORIZON} < c as train, t >= c + {_HORIZON} and t + {_HORIZON} < a as cal, t >= a + {_HORIZON} and t + {_HORIZON} < b as test from spans, x where t < b),
 sizes as (select fold, market, count(*) filter (train) as train, count(*) filter (cal) as calibration, count(*) filter (test) as test, count(distinct target) filter (train) as classes from parts group by 1, 2),
 classes as (select fold, market, target, avg(v) as mean from parts where train group by 1, 2, 3), groups as (select distinct market, cohort, target from x),
 means as (select fold, market, cohort, target, count(*) as n, avg(v) as mean from parts where train group by 1, 2, 3, 4)
select strftime(s.fold, '%Y-%m') as fold, g.market, g.cohort, g.target, coalesce(n, 0) as n, round(case when coalesce(n, 0) >= 30 then m.mean else c.mean end + {_OFF_TIES}::double, 6) as expected, coalesce(n, 0) < 30 as from_market, train, calibration, test
 from sizes s join groups g on g.market = s.market join classes c on c.fold = s.fold and c.market = g.market and c.target = g.target left join means m on m.fold = s.fold and m.market = g.market and m.cohort = g.cohort and m.target = g.target where classes = 2""",
)
def b16(spark, d):
    x = prints(spark, d).select(F.when(F.col("is_buyer_maker"), "maker").otherwise("taker").alias("market"), "symbol", "ts_ms", (F.col("drift") - F.col("spread")).cast("double").alias("net"))
    x = walkforward.monthly_expectations(x, "market", "symbol", "ts_ms", "net", 1.0, _HORIZON, 2, 30)
    return rounded(x.withColumns({"fold": F.date_format("fold", "yyyy-MM"), "expected": F.col("expected") + _OFF_TIES}))
