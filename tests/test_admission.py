import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import gates, joins, kernels, metrics
from marketloom.plans import admission, market

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in market.queries().items() if f.__module__ == admission.__name__]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in ("lineitem", "events"):
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
    assert len(ours)
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


def test_late_and_repeated_numbers_go(spark):
    x = spark.createDataFrame([("X", t, n) for t, n in enumerate([5, 5, 3, 7, 6, 8])], "symbol string, t int, n int")
    assert [r["n"] for r in gates.monotone(x, "symbol", ["t"], "n").orderBy("t").collect()] == [5, 7, 8]


def _path(spark, rows):
    base = [("X", "v", i * 10, i * 10 + 9, 1.0, 1.0, True, i * 10 + 9, i * 10 + 9) for i in range(3)]
    names = "symbol string, venue string, open_time_ms long, close_time_ms long, close double, previous_close double, closed boolean, event_ms long, receipt_ms long"
    x = spark.createDataFrame([tuple(rows.get(i, {}).get(k, v) for k, v in zip(names.replace(", ", " ").split()[::2], row)) for i, row in enumerate(base)], names)
    return gates.path_failures(x, ["symbol"], ["venue"], 10, 5).collect()[0]["failure"]


@pytest.mark.parametrize(
    ("rows", "failure"),
    [
        ({}, None),
        ({0: {"venue": "w"}, 1: {"closed": False}}, "IDENTITY_DRIFT"),
        ({1: {"closed": False}, 2: {"event_ms": 0}}, "ROW_NOT_CLOSED"),
        ({1: {"event_ms": 18}}, "EVENT_PRECEDES_CLOSE"),
        ({1: {"receipt_ms": 18}}, "RECEIPT_PRECEDES_EVENT"),
        ({2: {"receipt_ms": 35}}, "RECEIPT_AFTER_CUTOFF"),
        ({0: {"open_time_ms": -10, "close_time_ms": -1}}, "GAP_OR_DUPLICATE"),
        ({2: {"previous_close": 2.0}}, "CLOSE_CHAIN_MISMATCH"),
    ],
)
def test_first_failing_row_of_a_path(spark, rows, failure):
    assert _path(spark, rows) == failure


def test_first_missing_slot(spark):
    x = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 4, 4), ("b", 1, 2), ("b", 2, 2), ("c", 9, 3), ("d", 1, 2)], "s string, k long, due long")
    got = {r["s"]: (r["missing"], r["first_missing"]) for r in gates.due_slots(x, "s", "k", "due").collect()}
    assert got == {"a": (1, 3), "b": (0, None), "c": (3, 1), "d": (1, 2)}


def test_contexts_keep_zero_and_bounds(spark):
    x = spark.sql("select s, named_struct('price', 3.0, 'fast', 2.0, 'slow', 1.0) as c from values (0), (50), (98) as t(s)")
    got = x.select(gates.context_adjusted(F.col("s"), F.lit(True), "c", "c").alias("up"), gates.context_adjusted(F.col("s"), F.lit(False), "c", "c").alias("down")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (60, 40), (100, 88)]


def test_asof_in_buckets_is_the_whole_sort(spark):
    left = [("a", t, i) for i, t in enumerate([0, 5, 10, 10, 11, 35, 99, None])] + [("b", 3, 90), (None, 50, 91), ("c", 1, 92)]
    right = [("a", 5, 1.0), ("a", 10, 2.0), ("a", 90, 3.0), ("a", None, 9.0), (None, 2, 4.0), ("b", 4, 5.0)]
    l = spark.createDataFrame(left, "k string, t long, i long")
    r = spark.createDataFrame(right, "k string, u long, v double")
    for strict in (True, False):
        want = {}
        for k, t, i in left:
            seen = [(u, v) for q, u, v in right if q == k and u is not None and t is not None and (u < t or (u == t and not strict))]
            want[i] = max(seen)[1] if seen else None
        for bucket in (None, 10, 1000):
            got = joins.asof(l, r, ["k"], "t", "u", strict=strict, bucket_ms=bucket).collect()
            assert {x["i"]: x["matched"] and x["matched"]["v"] for x in got} == want
    aged = joins.asof(l, r, ["k"], "t", "u", strict=False, max_age=20, bucket_ms=10).where("i = 5").first()
    assert aged["matched"] is None
    assert joins.asof(l.limit(0), r.limit(0), ["k"], "t", "u", bucket_ms=10).count() == 0


def test_numbering_and_bins_split_a_key(spark):
    rows = [("a", t) for t in range(0, 300, 3)] + [("b", t) for t in (7, 1000, 5)] + [(None, 4), (None, 2)]
    x = spark.createDataFrame(rows, "k string, t long")
    want = {(k, t): i for k in ("a", "b", None) for i, t in enumerate(sorted(t for q, t in rows if q == k))}
    for bucket in (None, 10, 10_000):
        assert {(r["k"], r["t"]): r["at"] for r in kernels.placed(x, ["k"], ["t"], "at", bucket).collect()} == want
    n = {k: sum(q == k for q, _ in rows) for k in ("a", "b", None)}
    got = {(r["k"], r["t"]): r["bin"] for r in metrics.equal_count_bins(x, ["k"], ["t"], 4, "bin").collect()}
    assert got == {(k, t): ((i + 1) * 4 - 1) // n[k] for (k, t), i in want.items()}
