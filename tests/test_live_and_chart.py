"""Live guards, chart structure, clocks, walk-forward models, calendar bootstraps and files, by their SQL and by hand."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import calendar_bootstrap, clocks, structure, walkforward
from marketloom.plans import chart, clocks as clock_plans, files as file_plans, forecast, live, market, resampling  # noqa: F401 (they register)
from marketloom.sources import files
from marketloom.streaming import guards, streams

from test_signals import _ordered

SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"  # bars of the smallest tables have gaps, so none has structure
NAMES = {
    SMALL: ["t02_late_bars", "t03_intrabar_anomalies", "t05_sliding_flow", "t07_latest_quotes", "t08_stream_dedup_repeats", "t09_gap_hold", "j07_two_clocks", "w41_book_windows", "w44_liquidity_bars", "b03_paired_ratio_contrasts", "b04_moving_block_contrasts", "b06_exact_endpoints", "b07_shared_calendar_bounds", "b16_monthly_walk_forward", "s01_csv_rows", "s01_csv_faults", "s02_repeated_sink", "s03_funding_files", "s11_raw_events", "s16_artifacts", "o01_output_order", "f06_labels"],
    SF: ["p07_derived_hours", "w22_qualified_pivots", "w23_structure_state", "w24_pullback_metrics", "r03_pullback_rules"],
}


@pytest.mark.parametrize("folder, name", [(d, n) for d, names in NAMES.items() for n in names])
def test_queries_match_their_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            duck.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    theirs = _ordered(duck.sql(market.oracle_sql()[name]).df().astype(object))
    assert theirs and _ordered(market._queries[name](spark, folder).toPandas().astype(object)) == theirs


# ---- guards ----
def test_an_anomaly_needs_points_a_return_and_a_zscore():
    times = list(range(0, 60_000, 2_000))
    flat = [100 + 0.001 * (i % 3) for i in range(len(times))]
    assert guards.anomaly(times, flat, 30, 0.015, 4, 20) is None
    jump = [*flat[:-1], 103.0]
    change, zscore = guards.anomaly(times, jump, 30, 0.015, 4, 20)
    assert change == pytest.approx(103 / flat[14] - 1, abs=1e-4) and zscore > 4
    assert guards.anomaly(times[-19:], jump[-19:], 30, 0.015, 4, 20) is None
    # no point near the horizon
    assert guards.anomaly([*range(0, 19_000, 1_000), 59_000], [100.0] * 19 + [103.0], 30, 0.015, 4, 20) is not None
    assert guards.anomaly([*range(0, 19_000, 1_000), 44_000], [100.0] * 19 + [103.0], 30, 0.015, 4, 20) is not None
    assert guards.anomaly([*range(50_000, 69_000, 1_000), 70_000], [100.0] * 19 + [103.0], 30, 0.015, 4, 20) is None


def test_bars_behind_a_gap_come_in_order_after_recovery(spark):
    bar = "symbol string, open_time_ms long, close double, arrival long"
    rows = lambda *x: spark.createDataFrame([("a", t * 10, float(c), n) for t, c, n in x], bar)
    parts = [
        {"live": rows((100, 1, 1), (101, 2, 2), (104, 5, 3)), "recovered": rows((99, 0, 0))},
        {"live": rows((105, 6, 4), (101, 9, 5)), "recovered": rows((102, 3, 6))},
        {"live": rows((106, 7, 8)), "recovered": rows((103, 4, 7), (102, 9, 9))},
    ]
    got = streams.fed(parts, lambda live, recovered: guards.gap_hold(live, recovered, 10, 10_000, "1 hour")).orderBy("place").collect()
    assert [(r["open_time_ms"] // 10, r["close"], r["is_recovered"], r["released_by"]) for r in got] == [(100, 1, False, 1), (101, 2, False, 2), (102, 3, True, 6), (103, 4, True, 7), (104, 5, False, 7), (105, 6, False, 7), (106, 7, False, 8)]


# ---- structure ----
def test_chunks_do_not_change_the_structure(spark):
    rng = random.Random(4)
    rows, price = [], 100.0
    for i in range(700):
        price += rng.choice([-1, 1]) * rng.random() + (0.1 if i // 90 % 2 else -0.1)
        if i not in (333, 334):
            rows.append(("a", i * 10, price + rng.random(), price - rng.random(), price, 10.0 + i % 7, 1.0 + i % 3 / 10 if i > 13 else None, price - 0.2 if i > 19 else None))
    bars = spark.createDataFrame(rows, "symbol string, open_time_ms long, high double, low double, close double, quote_volume double, atr double, ema20 double")
    whole = {tuple(r) for r in structure.structure(bars, 10).collect()}
    assert {tuple(r) for r in structure.structure(bars, 10, structure.HALO).collect()} == whole
    states = {r[6] for r in whole}
    assert len(whole) == len(rows) - 2 and states >= {None, "bullish", "bearish", "mixed"}
    pivots = {tuple(r) for r in structure.qualified_pivots(bars, 10).collect()}
    assert {tuple(r) for r in structure.qualified_pivots(bars, 10, structure.HALO).collect()} == pivots and pivots


# ---- clocks ----
def test_what_came_late_is_not_known(spark):
    seen = spark.createDataFrame([("a", 100, 105, 1, 1.0), ("a", 110, 200, 2, 2.0), ("a", 120, 121, 3, 3.0), ("a", 90, 91, 4, 4.0), ("a", 90, 91, 4, 5.0)], "k string, event long, receipt long, seq long, v double")
    asked = spark.createDataFrame([("a", 115, 130), ("a", 115, 250), ("a", 95, 95), ("b", 95, 95), ("a", 500, 600)], "k string, cutoff long, deadline long")
    got = {(r["k"], r["cutoff"], r["deadline"]): (r["v"], r["n_candidates"], r["n_conflicts"]) for r in clocks.two_clock_latest(asked, seen, ["k"], "cutoff", "deadline", "event", "receipt", "seq", ["v"], 30).collect()}
    assert got == {("a", 115, 130): (1.0, 3, 1), ("a", 115, 250): (2.0, 4, 1), ("a", 95, 95): (4.0, 2, 1), ("b", 95, 95): (None, 0, 0), ("a", 500, 600): (None, 0, 0)}


def test_windows_of_a_covered_bar_add_up(spark):
    rows = [("a", t, i, float(i)) for i, t in enumerate([-4_000, 3_000, 3_000, 40_000, 280_000, 299_000, 310_000])]
    states = spark.createDataFrame(rows, "k string, t long, seq long, v double")
    got = clocks.book_windows(states, ["k"], "t", "seq", ["v"]).where("open_ms = 0").groupBy("window").agg(F.sum("duration_ms").alias("d"), F.max("expected_ms").alias("e"), F.collect_set("v").alias("v")).collect()
    assert {r["window"] for r in got} == set(clocks.BOOK_WINDOWS) and all(r["d"] == r["e"] for r in got)
    assert {r["window"]: sorted(r["v"]) for r in got}["first_5s"] == [0.0, 2.0]
    # a state that is too old covers nothing
    stale = clocks.book_windows(states, ["k"], "t", "seq", ["v"], max_age_ms=100_000).where("open_ms = 0 and window = 'full'").agg(F.sum("duration_ms")).first()[0]
    assert stale == 3_000 + 37_000 + 100_000 + 19_000 + 1_000


# ---- models ----
def test_models_of_folds_match_numpy(spark):
    rng = np.random.default_rng(3)
    n = 900
    t = np.arange(n) * 10
    x = np.column_stack([rng.normal(5, 2, n), rng.normal(0, 1, n), np.full(n, 3.0)])
    asset = np.where(np.arange(n) < 500, np.array(["a", "b"])[np.arange(n) % 2], np.array(["a", "b", "c"])[np.arange(n) % 3])
    y = 2 * x[:, 0] - x[:, 1] + (asset == "b") + rng.normal(0, 1, n)
    up = (x[:, 1] + (asset == "a") + rng.normal(0, 1, n)) > 0
    rows = [(int(t[i]), *map(float, x[i]), str(asset[i]), float(y[i]), bool(up[i])) for i in range(n)]
    frame = spark.createDataFrame([*rows, (5, None, 0.0, 0.0, "a", 1.0, True)], "t long, x0 double, x1 double, x2 double, asset string, y double, up boolean").repartition(7)
    schedule = walkforward.Schedule.of(frame, "t", 3_000, 1_000, 50)
    found = walkforward.fit_folds(frame, "t", ["x0", "x1", "x2"], "asset", "y", "up", schedule)
    assert schedule.folds == 6 and found.assets == ["a", "b", "c"]
    for fold in range(schedule.folds):
        mine = t < 3_000 + fold * 1_000 - 50
        mean, scale = x[mine].mean(0), x[mine].std(0)
        scale[scale < 1e-9] = 1
        m = np.column_stack([np.ones(mine.sum()), (x[mine] - mean) / scale, *((asset[mine] == a) for a in "abc")])
        penalty = np.diag([0.0] + [1.0] * 6)
        ridge = np.linalg.solve(m.T @ m + penalty, m.T @ y[mine])
        assert np.allclose(found.ridge[fold], ridge, atol=1e-8)
        beta = np.zeros(7)
        for _ in range(40):
            p = 1 / (1 + np.exp(-m @ beta))
            beta = beta + np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + penalty, m.T @ (up[mine] - p) - penalty @ beta)
        assert np.allclose(found.logistic[fold], beta, atol=1e-8)
    tests = walkforward.predicted(frame, found, "t", "asset").where("x0 is not null").collect()
    assert len(tests) == sum(t >= 3_000) and {r["fold"] for r in tests if r["unseen_asset"]} == {2}
    r = next(r for r in tests if r["fold"] == 4)
    mine = t < 7_000 - 50
    value = np.array([1, *((np.array([r["x0"], r["x1"], r["x2"]]) - x[mine].mean(0)) / np.where(x[mine].std(0) < 1e-9, 1, x[mine].std(0))), *(float(r["asset"] == a) for a in "abc")])
    assert r["expected"] == pytest.approx(value @ found.ridge[4]) and r["probability"] == pytest.approx(1 / (1 + np.exp(-value @ found.logistic[4])))


# ---- bootstraps ----
def test_draws_are_shared_and_few_resamples_give_no_endpoints(spark):
    daily = spark.createDataFrame([("a", 0, 5, 1), ("a", 3, 7, 2), ("b", 3, 7, 2), ("b", 0, 5, 1), ("c", 1, 0, 0)], "g string, day int, top long, bottom long")
    draws = calendar_bootstrap.resampled(daily, ["g"], "day", ["top", "bottom"], 5, 20, 2)
    rows = {g: sorted((r["rep"], r["top"], r["bottom"]) for r in draws.where(f"g = '{g}'").collect()) for g in "abc"}
    assert rows["a"] == rows["b"] and len(rows["a"]) == 20 and {x[1:] for x in rows["c"]} == {(0, 0)}
    ends = {r["g"]: r for r in calendar_bootstrap.exact_endpoints(draws, ["g"], "top", "bottom").collect()}
    assert ends["a"]["feasible"] == "scarce" and ends["a"]["low_top"] is None and ends["c"]["feasible"] == "empty"
    moving = calendar_bootstrap.schedule(spark, 5, 50, 2, False).collect()
    assert all(0 <= r["begin"] <= 5 - r["size"] for r in moving) and {r["size"] for r in moving} == {1, 2}


# ---- files ----
def test_any_fault_makes_its_file_go(spark, tmp_path):
    import gzip

    header = ",".join(files.FUNDING_COLUMNS)
    bodies = {
        "good": f"{header}\nA,0,9,1,0.5,\nA,0,9,2,0.25,7\n", "header": f"{header},x\nA,0,9,1,0.5,\n", "empty": f"{header}\n", "mixed": f"{header}\nA,0,9,1,0.5,\nB,0,9,1,0.5,\n",
        "number": f"{header}\nA,0,9,1,0.5,\nA,0,9,two,0.5,\n", "long": f"{header}\nA,0,9,1,0.5,7,8\n", "short": f"{header}\nA,0,9\n",
    }
    for name, body in bodies.items():
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(body)
    rows, faults = files.scan_strict(spark, f"file://{tmp_path}/*.csv.gz", files.FUNDING_COLUMNS, files.FUNDING_IDENTITY, ("mark_price",))
    assert sorted((r["funding_time_ms"], r["rate"], r["mark_price"], r["line"]) for r in rows.collect()) == [(1, 0.5, None, 2), (2, 0.25, 7.0, 3)]
    found = {(r["file"].rsplit("/", 1)[1].removesuffix(".csv.gz"), r["line"], r["reason"]) for r in faults.collect()}
    assert found == {("header", 1, "header"), ("empty", 1, "empty"), ("mixed", 3, "identity"), ("number", 3, "values"), ("long", 2, "values"), ("short", 2, "values")}


def test_numbers_over_many_parts(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("a"), (F.col("id") % 3).alias("g"), "id")
    got = files.numbered(rows, ["a", "id"], "n", ["g"]).collect()
    for g in range(3):
        mine = sorted((r["a"], r["id"], r["n"]) for r in got if r["g"] == g)
        assert [x[2] for x in mine] == list(range(1, len(mine) + 1))


def test_large_feeds_come_in_more_parts(spark, monkeypatch):
    monkeypatch.setattr(live, "ROWS", 150)
    x = spark.range(1000).select(F.col("id").alias("arrival"))
    parts = [p.count() for p in live._parts(x)]
    assert len(parts) == 7 and sum(parts) == 1000 and max(parts) <= 150
    test_queries_match_their_sql(spark, SMALL, "t07_latest_quotes")


def test_prices_of_one_millisecond_are_judged_once(monkeypatch):
    rng = np.random.default_rng(3)
    t = (np.arange(4000) // 40 * 2000 - np.where(np.arange(4000) % 37 == 0, 4000, 0)).astype("int64")
    p = 100 + rng.integers(0, 3, 4000) * 0.01 + np.where(t // 60_000 % 2 == 1, 5.0, 0.0)
    times, prices, want = [], [], []
    for n in range(4000):
        if times and t[n] < times[-1]:
            continue
        if times and t[n] == times[-1]:
            prices[-1] = p[n]
        else:
            times.append(int(t[n]))
            prices.append(p[n])
        first = max(next(i for i, x in enumerate(times) if x >= t[n] - 600_000), len(times) - 50)
        del times[:first], prices[:first]
        want.append((n, t[n], p[n], *(guards.anomaly(times, prices, 30, 0.015, 4, 20) or (None, None))))
    calls, judge = [], guards.anomaly
    monkeypatch.setattr(guards, "anomaly", lambda *a: calls.append(1) or judge(*a))
    held, got = ([], []), []
    for part in np.array_split(np.arange(4000), 3):
        got.append(guards.evaluated(part, t[part], p[part], *held, 600_000, 50, 30, 0.015, 4, 20))
    got = [tuple(None if x != x else x for x in r) for f in got for r in f.itertuples(index=False)]
    assert got == want and any(r[3] for r in want) and held == (times, prices)
    assert len(calls) < 500
