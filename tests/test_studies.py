import hashlib
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import audit, evidence, series
from marketloom.plans import market, studies

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in studies.queries().items() if f.__module__ == studies.__name__]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in ("orders", "lineitem", "customer", "events", "documents", "labels"):
        c.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return c


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    ours = _ordered(market.queries()[name](spark, SMALL).toPandas())
    theirs = _ordered(duck.sql(market.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


def _series(spark, values):
    return spark.createDataFrame([("X", 0, i, float(v)) for i, v in enumerate(values)], "symbol string, seg long, open_time_ms long, close double")


def test_robust_z_of_short_and_flat_series(spark):
    x = evidence.robust_z(_series(spark, [1, 2, 3, 4, 10, 5, 5, 5, 5, 5]), "close", 4).orderBy("open_time_ms").collect()
    assert [r["z_status"] for r in x] == ["WARMUP"] * 4 + ["OK"] * 4 + ["ZERO_SCALE"] * 2
    assert x[4]["z"] == pytest.approx(7.5 / 1.4826) and x[9]["z"] is None


def test_prior_ecdf_leaves_out_its_own_row(spark):
    x = _series(spark, [1, 2, 3, 2]).withColumn("e", evidence.prior_ecdf("close", 3)).orderBy("open_time_ms").collect()
    assert [r["e"] for r in x] == [None, None, None, pytest.approx(2 / 3)]


def test_missing_slots_and_empty_tables(spark):
    x = spark.createDataFrame([("a", 0), ("a", 10), ("a", 40), ("b", 7)], "k string, t long")
    assert [tuple(r) for r in audit.missing_slots(x, "k", "t", 10).orderBy("t").collect()] == [("a", 20), ("a", 30)]
    assert audit.missing_slots(x.where("t < 0"), "k", "t", 10).count() == 0


def test_failures_name_every_broken_rule(spark):
    x = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id long, v long")
    found = audit.failures(x, {"negative": F.col("v") < 0, "odd": F.col("v") % 2 != 0}, ["id"]).orderBy("id", "rule").collect()
    assert [tuple(r) for r in found] == [("odd", 1), ("negative", 3), ("odd", 3)]


def test_sigmoid_fit_takes_the_true_grid_point(spark):
    rows = [(x / 10, 1 if i < round(1000 / (1 + 2.718281828 ** -(x / 20 + 1.0))) else 0) for x in range(-40, 41, 8) for i in range(1000)]
    df = spark.createDataFrame(rows, "logit double, y int").withColumn("g", F.lit("all"))
    best = evidence.fit_sigmoid(df, ["g"], "logit", "y", [1.0, 2.0, 4.0], [0.0, 1.0, 2.0]).first()
    assert (best["temperature"], best["intercept"]) == (2.0, 1.0)


def test_stale_time_is_cut_off(spark):
    x = spark.createDataFrame([("s", 0, "up"), ("s", 5, "down"), ("s", 30, "up")], "k string, t long, c string")
    found = {r["category"]: r["covered_ms"] for r in audit.coverage_time(x, "k", "t", "c", 10).collect()}
    assert found == {"up": 5, "down": 10, "stale": 15}


def test_the_later_id_counts_among_states_of_one_time(spark, tmp_path):
    rows = [(4, 0.0), (3, 0.0), (7, 1.0), (6, 5.0), (5, 5.0), (8, 5.0), (9, 6.0)]
    x = spark.createDataFrame(rows, "event_id long, s double").select("event_id", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    x.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["category"]: (r["covered_ms"], r["longest_ms"]) for r in market._queries["c06_coverage_time"](spark, str(tmp_path)).collect()}
    assert found == {"valid": (2000, 1000), "waiting": (4000, 4000)}


def test_verdict_of_a_missing_value_fails(spark):
    x = spark.createDataFrame([("a", None)], "k string, v double")
    assert evidence.verdicts(x, ["k"], {"c": ("v", ">=", 0)}).first()["passed"] is False


def test_taker_delta_needs_all_its_bars(spark):
    rows = [("X", 0, i, 10.0, 7.5) for i in range(4)]
    x = spark.createDataFrame(rows, "symbol string, seg long, open_time_ms long, quote_volume double, taker_quote double")
    assert [r["d"] for r in x.withColumn("d", evidence.taker_delta(3)).orderBy("open_time_ms").collect()] == [None, None, 0.5, 0.5]
    assert series.segment() is not None


@pytest.mark.parametrize("ranges", [1, 8, 4096])
def test_matched_draws_are_the_rows_of_smallest_hash(spark, monkeypatch, ranges):
    monkeypatch.setattr(evidence, "RANGES", ranges)
    rows = [("a" if i % 3 else "b", i, i % 5 == 0, None if i % 11 == 0 else float(i)) for i in range(300)]
    rows += [("all", i, True, 1.0) for i in range(300, 310)] + [("none", i, False, 1.0) for i in range(310, 320)]
    x = spark.createDataFrame(rows, "k string, id long, c boolean, v double")
    got = {r["rep"]: (r["picked"], r["random_mean"]) for r in evidence.matched_random(x, "k", "id", "c", "v", 3).collect()}
    for rep in range(3):
        picked = []
        for k in ("a", "b", "all"):
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: (hashlib.md5(f"11|{rep}|{r[1]}".encode()).hexdigest()[:8], r[1]))
            picked += mine[: sum(r[2] for r in mine)]
        values = [r[3] for r in picked if r[3] is not None]
        assert got[rep] == (len(picked), pytest.approx(sum(values) / len(values)))


def test_failures_by_key_are_those_of_each_row(spark):
    x = spark.createDataFrame([(1, 5), (1, -1), (2, None), (3, -1), (None, 1), (None, -3)], "id long, v long")
    rules = {"negative": F.col("v") < 0, "odd": F.col("v") % 2 != 0}
    found = audit.failures_by_key(x, rules, ["id"], "twice")
    assert {tuple(r) for r in found.collect()} == {("twice", 1, 2), ("odd", 1, 2), ("negative", 1, 1), ("negative", 3, 1), ("odd", 3, 1), ("twice", None, 2), ("odd", None, 2), ("negative", None, 1)}
    each = audit.failures(x, rules, ["id"]).groupBy("rule", "id").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in found.where("rule != 'twice'").collect()} == {tuple(r) for r in each.collect()}
    plan = market._queries["p16_integrity"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
