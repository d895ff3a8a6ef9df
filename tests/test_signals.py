import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import joins, records, rules, signals
from marketloom.plans import market, records as record_plans, signals as signal_plans  # noqa: F401 (they register)

SF = "/root/testdata/sf0.001"
NAMES = ["a16_pair_rates", "c02_snapshot_bridge", "f12_score_buckets", "j11_first_touch", "j13_variant_alignment", "s09_depth_rows", "t12_late_conflicts", "t04_state_changes", "r10_strongest_rule", "j16_leave_one_out"]


def _ordered(frame: pd.DataFrame) -> list[tuple]:
    tidy = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v
    rows = [tuple(tidy(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            duck.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    theirs = _ordered(duck.sql(market.oracle_sql()[name]).df().astype(object))
    assert _ordered(market._queries[name](spark, SF).toPandas().astype(object)) == theirs


def test_interval_sum_keeps_equal_events_and_spans_buckets(spark):
    e = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 5, 30), ("b", 0, 10), ("a", 9, 3)], "k string, s long, e long")
    p = spark.createDataFrame([("a", 0, 8.0), ("a", 1, 1.0), ("a", 9, 2.0), ("a", 10, 4.0), ("a", 29, 16.0)], "k string, t long, v double")
    got = sorted((r["k"], r["s"], r["x"]) for r in joins.interval_sum(e, p, ["k"], "s", "e", "t", F.col("v"), "x", 7).collect())
    assert got == [("a", 0, 3.0), ("a", 0, 3.0), ("a", 5, 22.0), ("a", 9, 0.0), ("b", 0, 0.0)]


def _evaluated(spark, rows):
    return spark.createDataFrame([("s", "f", t, score, triggered, float(t), True, False) for t, score, triggered in rows], "symbol string, family string, open_time_ms long, score int, triggered boolean, invalidation double, eligible boolean, informational boolean")


def test_states_cool_down_and_invalidate(spark):
    rows = [(1, 45, False), (2, 65, False), (3, 80, True), (4, 45, False), (5, 80, True), (6, 0, False), (20, 45, False), (21, 0, False), (22, 80, True), (40, 0, False)]
    got = [(r["open_time_ms"], r["stage"], r["invalidation"]) for r in rules.state_changes(_evaluated(spark, rows), cooldown_ms=10, bucket_ms=5).orderBy("open_time_ms").collect()]
    # 4 to 12 fall in the cooldown of 3; the fall from CONFIRMED at 40 is no decision
    assert got == [(1, "WATCH", 1.0), (2, "SETUP", 2.0), (3, "CONFIRMED", 3.0), (20, "WATCH", 20.0), (21, "INVALIDATED", 20.0), (22, "CONFIRMED", 22.0)]


def test_informational_rules_never_confirm_and_come_last(spark):
    f = spark.createDataFrame([(1, 5.0)], "t long, close double")
    every = F.col("close") > 0
    asked = [rules.Rule("loud", 1, every, {90: every}, every, informational=True), rules.Rule("quiet", 1, every, {50: every}, F.lit(False)), rules.Rule("barred", 1, every, {70: every}, every, eligible=F.lit(False)), rules.Rule("twin", 1, every, {50: every}, F.lit(False))]
    assert rules.strongest(rules.evaluate(f, asked), ["t"]).first()["family"] == "quiet"


def test_sorted_window_is_the_same_in_one_chunk_and_in_many(spark):
    rng = np.random.default_rng(3)
    rows = [("k", i, float(v)) for i, v in enumerate(rng.integers(0, 9, 120))] + [("short", 0, 1.0), ("k", 500, None)]
    x = spark.createDataFrame(rows, "k string, t long, v double")
    one, many = (sorted(map(tuple, records.sorted_window(x, ["k"], ["t"], "v", 20, chunk).collect()), key=repr) for chunk in (1000, 25))
    values = np.array([v for k, _, v in rows if k == "k" and v is not None])
    want = {i: ((m := np.median(values[i - 20 : i])), np.median(np.abs(values[i - 20 : i] - m)), (values[i - 20 : i] <= values[i]).mean()) for i in range(20, 120)}
    assert one == many and {r[1]: r[3:] for r in one if r[3] is not None} == want


def test_first_touch_decides_at_the_open_and_sees_collisions(spark):
    e = spark.createDataFrame([("s", 0, 1, 100.0, 90.0), ("s", 10, 1, 100.0, 90.0), ("s", 20, -1, 100.0, 110.0), ("s", 30, 1, 100.0, 120.0), ("s", 40, 1, 100.0, 90.0)], "symbol string, open_time_ms long, direction int, entry double, invalidation double")
    bars = spark.createDataFrame([("s", 10, 115.0, 120.0, 80.0), ("s", 20, 100.0, 111.0, 89.0), ("s", 30, 100.0, 105.0, 95.0), ("s", 40, 100.0, 101.0, 85.0), ("s", 50, 100.0, 101.0, 99.0)], "symbol string, open_time_ms long, open double, high double, low double")
    got = {r["open_time_ms"]: (r["status"], r["at_ms"]) for r in signals.first_touch(e, bars, 10, 2).collect()}
    assert got == {0: ("TARGET_FIRST", 10), 10: ("COLLISION", 29), 20: ("TARGET_FIRST", 49), 30: ("INVALID_INVALIDATION", None), 40: ("TIMEOUT", 59)}
