import os

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.operators import policy
from marketloom.plans import market, policy as policy_plans  # noqa: F401 (it registers)

from test_signals import _ordered

SF = "/root/testdata/sf0.01"  # bars of the smallest tables have gaps, so none has all features
NAMES = ["r07_entry_gates", "r09_gated_rules", "j22_fee_versions", "a24_position_fees", "c09_clock_cutoff", "c17_first_reaching"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            duck.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    theirs = _ordered(duck.sql(market.oracle_sql()[name]).df().astype(object))
    assert theirs and _ordered(market._queries[name](spark, SF).toPandas().astype(object)) == theirs


_GATE = "direction int, ema20 double, ema50 double, adx double, ema20_slope_atr double, volume_zscore double, trade_count_zscore double, taker_imbalance double, cvd_pressure double, funding_zscore double, spread_bps double, spread_is_proxy boolean, completeness double"


def _gates(spark, rows, **more):
    return [(r["trend_score"], r["participation_score"], r["crowding_risk"], r["execution_score"], list(r["failures"]), r["passed"]) for r in policy.entry_gates(spark.createDataFrame(rows, _GATE).coalesce(1), **more).collect()]


def test_gates_do_not_make_up_for_each_other(spark):
    good = (1, 2.0, 1.0, 25.0, 0.5, 1.0, 0.0, 0.2, 0.1, 0.0, 5.0, False, 1.0)
    short = (-1, 1.0, 2.0, 16.0, -0.5, 0.6, 0.0, -0.05, -0.02, -2.5, 12.0, True, 1.0)
    bare = (1, 2.0, 1.0, 25.0, 0.5, 1.0, 0.0, None, 0.1, None, None, False, 0.5)
    assert _gates(spark, [good, short, bare], futures=F.lit(True)) == [
        (100, 100, 10, 100, [], True),
        (90, 70, 75, 65, ["crowding"], False),
        (100, 0, 100, 0, ["no flow", "no funding", "crowding", "execution", "spread", "completeness"], False),
    ]


def test_contexts_add_points_and_must_be_there(spark):
    x = spark.createDataFrame([(1, 2.0, 1.0, 25.0, 0.5)], "direction int, ema20 double, ema50 double, adx double, ema20_slope_atr double")
    x = x.select("*", F.expr("named_struct('ema20', 2D, 'ema50', 1D, 'price', 3D)").alias("near"), F.expr("cast(null as struct<ema20:double,ema50:double,price:double>)").alias("far"))
    assert x.select(policy.trend_score(F.col("direction"), ("near", "far")).alias("s")).first()["s"] == 85


def test_failed_rules_lose_their_score_and_informational_ones_never_pass(spark):
    x = spark.createDataFrame([(0, True, False), (70, True, False), (90, False, False), (70, True, True)], "score int, passed boolean, informational boolean").coalesce(1)
    got = [(r["raw_score"], r["score"], r["eligible"]) for r in policy.apply_gates(x, 80, keep_failed=False).collect()]
    assert got == [(0, 0, True), (70, 80, True), (90, 0, False), (70, 70, False)]


def test_fee_versions_are_known_at_and_between_equal_captures(spark):
    captures = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 1.0), ("a", 30, 2.0)], "k string, t long, v double")
    fills = spark.createDataFrame([("a", t) for t in (5, 10, 15, 25, 30, 35, 35)] + [("b", 1)], "k string, at long")
    got = sorted((r["k"], r["at"], r["fee_status"], r["fee_rate"]) for r in policy.fee_versions(fills, captures, ["k"], "at", "t", "v").collect())
    late = ("a", 35, "PENDING_OPEN_TAIL", None)
    assert got == [("a", 5, "NO_CAPTURE_BEFORE", None), ("a", 10, "RESOLVED", 1.0), ("a", 15, "RESOLVED", 1.0), ("a", 25, "INCONCLUSIVE_FEE_VERSION", None), ("a", 30, "RESOLVED", 2.0), late, late, ("b", 1, "NO_CAPTURE_BEFORE", None)]


def test_first_receipt_that_reaches_each_target(spark):
    x = spark.createDataFrame([("a", 1, 12), ("a", 2, None), ("a", 3, 35), ("a", 4, 20), ("a", 5, 38), ("a", 6, 40), ("b", 1, None)], "k string, t long, low long")
    got = sorted((r["target_ms"], r["t"]) for r in policy.first_reaching(x, ["k"], ["t"], "low", 10).collect())
    assert got == [(10, 1), (20, 3), (30, 3), (40, 6)]


def test_action_labels(spark):
    rows = [("spot", "breakout_long", 1), ("spot", "breakdown_short", -1), ("futures", "technical_exit", -1), ("spot", "technical_exit", 1), ("futures", "breakout_long", 1), ("spot", "pump_risk", 1)]
    x = spark.createDataFrame(rows, "m string, f string, d int").coalesce(1).select(policy.action_label(F.col("m"), F.col("f"), F.col("d")).alias("x"))
    assert [r["x"] for r in x.collect()] == ["SPOT_BUY", "SPOT_EXIT", "FUTURES_SHORT_EXIT", "SPOT_EXIT", "FUTURES_LONG", "PUMP_RISK"]
