import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marketloom.functions import scalars
from marketloom.operators import clean, coverage, inference, joins, kernels, metrics, rules, series
from marketloom.plans import market

STEP = 300_000


def bars(spark, n=260, gap=None, change=None):
    rows = []
    for i in range(n):
        if i == gap:
            continue
        c = 100 + float(np.sin(i / 5)) + (5.0 if change is not None and i >= change else 0.0)
        rows.append(("X", i * STEP, i * STEP + STEP - 1, c - 0.1, c + 0.5, c - 0.5, c, 100.0 + i % 7, (100.0 + i % 7) * c, 55.0 * c, 100 + i % 3))
    return spark.createDataFrame(rows, "symbol string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, volume double, quote_volume double, taker_quote double, trade_count long")


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_smoother_is_seeded_with_the_mean():
    out = kernels.smooth(np.array([1.0, 2.0, 3.0, 4.0]), 3, 0.5)
    assert np.isnan(out[:2]).all() and out[2] == 2.0 and out[3] == 3.0


def test_flat_series_has_rsi_fifty():
    frame = pd.DataFrame({"close": [5.0] * 40, "high": [6.0] * 40, "low": [4.0] * 40})
    out = kernels.indicators(frame)
    assert out["rsi"].iloc[-1] == 50.0 and out["adx"].iloc[-1] == 0.0


def test_chunks_agree_with_the_whole_series(spark):
    x = series.with_segments(bars(spark, 900), STEP)
    names = ["open_time_ms", "ema9", "rsi", "atr", "adx"]
    whole = kernels.recursive_series(x).select(names).orderBy("open_time_ms").toPandas()
    cut = kernels.recursive_series(x, chunk_rows=400, run_in=390).select(names).orderBy("open_time_ms").toPandas()
    assert len(cut) == 900
    np.testing.assert_allclose(whole.to_numpy(float), cut.to_numpy(float), rtol=1e-9)


@pytest.mark.parametrize("function", [lambda b: series.window_features(b, STEP), lambda b: kernels.recursive_series(series.with_segments(b, STEP))])
def test_no_feature_looks_ahead(spark, function):
    a = function(bars(spark)).where(F.col("open_time_ms") < 200 * STEP).orderBy("open_time_ms").toPandas()
    b = function(bars(spark, change=200)).where(F.col("open_time_ms") < 200 * STEP).orderBy("open_time_ms").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_row_order_does_not_matter(spark):
    a = series.window_features(bars(spark), STEP).orderBy("open_time_ms").toPandas()
    b = series.window_features(bars(spark).repartition(7).orderBy(F.rand(3)), STEP).orderBy("open_time_ms").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_gap_restarts_the_segment(spark):
    x = series.window_features(bars(spark, gap=100), STEP)
    row = x.where(F.col("open_time_ms") == 101 * STEP).first()
    assert row["recent_high"] is None and row["true_range"] == pytest.approx(1.0)
    found = clean.gaps(bars(spark, gap=100), STEP).collect()
    assert [(r["after_ms"], r["missing"]) for r in found] == [(99 * STEP, 1)]


def test_resample_drops_incomplete_bars(spark):
    found = {r["bucket_ms"] for r in clean.resample(bars(spark, 36, gap=13), STEP, 12 * STEP).collect()}
    assert found == {0, 24 * STEP}


def test_asof_excludes_equal_times_when_strict(spark):
    l = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t long")
    r = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0)], "k string, u long, v double")
    strict = {(x["k"], x["t"]): x["matched"] and x["matched"]["v"] for x in joins.asof(l, r, ["k"], "t", "u").collect()}
    loose = {(x["k"], x["t"]): x["matched"] and x["matched"]["v"] for x in joins.asof(l, r, ["k"], "t", "u", strict=False, max_age=4).collect()}
    assert strict == {("a", 10): None, ("a", 20): 2.0, ("b", 5): None}
    assert loose == {("a", 10): 1.0, ("a", 20): None, ("b", 5): None}


def test_interval_sum_is_open_on_both_ends(spark):
    e = spark.createDataFrame([(1, "a", 10, 20)], "id long, k string, s long, e long")
    p = spark.createDataFrame([("a", t, 1.0) for t in (10, 11, 19, 20)], "k string, t long, v double")
    assert joins.interval_sum(e, p, ["k"], "s", "e", "t", F.col("v"), "x", 7).first()["x"] == 2.0


def test_forward_outcome_needs_a_contiguous_path(spark):
    x = joins.forward_outcomes(bars(spark, 40, gap=20), STEP, 3)
    by = {r["open_time_ms"] // STEP: r for r in x.collect()}
    assert by[10]["exit"] == by[13]["close"] and by[10]["entry"] == by[11]["open"]
    assert by[18]["excluded"] == "GAP" and by[39]["excluded"] == "OUT_OF_RANGE"


def test_costs_are_symmetric(spark):
    one = spark.range(1)
    long = one.select(*(c.alias(n) for n, c in scalars.execution_returns(F.lit(1), F.lit(100.0), F.lit(110.0), 5, 2).items())).first()
    assert long["gross_return"] == pytest.approx(0.1)
    assert long["net_return"] == pytest.approx((110 * 0.9998 - 100 * 1.0002) / 100 - 0.0005 * (100.02 + 110 * 0.9998) / 100)


def test_interval_text(spark):
    x = spark.createDataFrame([("5m",), ("2h",), ("x",), ("1w",)], "t string")
    assert [r[0] for r in x.select(scalars.interval_ms(F.col("t"))).collect()] == [300_000, 7_200_000, None, 604_800_000]


def test_registered_rule_joins_the_fan_out(spark):
    f = bars(spark, 3)
    rule = rules.Rule("cheap", 1, F.col("close") > 0, {70: F.col("close") > 0})
    assert rules.evaluate(f, [rule]).where("score = 70 and triggered").count() == 3


def test_non_overlapping_takes_the_earliest_exit(spark):
    e = spark.createDataFrame([("a", 0, 10), ("a", 1, 5), ("a", 5, 7), ("a", 6, 20)], "k string, s long, e long")
    got = sorted((r["s"], r["e"]) for r in rules.non_overlapping(e, ["k"], "s", "e").collect())
    assert got == [(1, 5), (5, 7)]


def test_non_overlapping_matches_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), i, t := rng.randrange(300), t + rng.choice([0, 0, 1, 3, 9, 40])) for i in range(500)]
    e = spark.createDataFrame(rows, "k string, id long, s long, e long")
    for by in (["k"], []):
        want = []
        for k in {r[0] for r in rows} if by else [...]:
            last = None
            for x, s, name, i in sorted((x, s, n or "", i) for n, i, s, x in rows if k is ... or n == k):
                if last is None or s >= last:
                    want.append((name, i, s, x))
                    last = x
        got = rules.non_overlapping(e, by, "s", "e", ["id"] if by else ["k", "id"], 50)
        assert sorted((r["k"] or "", r["id"], r["s"], r["e"]) for r in got.collect()) == sorted(want)


def test_positional_bars_decode_every_symbol(spark):
    d = "/root/testdata/sf0.001"
    sql, rows = market._oracles["s06_positional_bars_all"], market._queries["s06_positional_bars_all"](spark, d)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    want = sorted(con.execute(sql).fetchall())
    got = sorted(map(tuple, rows.collect()))
    assert len({r[0] for r in want}) == 3 and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_holm_is_monotone(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    got = {r["name"]: round(r["adjusted"], 6) for r in inference.holm(p, "name", "p").collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_depth_walk(spark):
    levels = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 9.0)], "k string, price double, qty double")
    r = coverage.walk(levels, ["k"], 5.0).first()
    assert (r["filled"], r["vwap"], r["levels"]) == (5.0, 9.0 / 5, 3)


def test_most_open_counts_exits_first(spark):
    e = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 6, 8)], "k string, s long, e long")
    assert metrics.most_open(e, ["k"], "s", "e").first()["most_open"] == 2


@pytest.mark.parametrize("name", ["a02_grouped_metrics", "a04_cube"])
def test_the_total_has_its_row_without_any_trade(spark, tmp_path, name):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(30).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = duck.sql(market.oracle_sql()[name]).fetchall()
    assert len(theirs) == 1 and [tuple(x) for x in market._queries[name](spark, str(tmp_path)).collect()] == theirs


def test_trailing_sums_agree_with_range_frames(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([None, -7, *range(0, 60)]), rng.choice([None, 1.0, -2.0, 5.0])) for _ in range(400)] + [("c", 3, None), (None, 4, 1.0), (None, 9, 2.0), ("d", 10, 1.0), ("d", 20, 2.0)]
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, t long, v double")
    got = series.trailing_sum(x, ["k"], "t", 10, F.col("v"), "s")
    w = series.Window.partitionBy("k").orderBy("t").rangeBetween(-10, 0)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in x.withColumn("s", F.sum("v").over(w)).collect()}
    plan = market._queries["a22_trailing_flow"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_bucket" in plan.split("hashpartitioning(symbol", 1)[1].split(")")[0]
