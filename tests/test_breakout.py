import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from marketloom.operators import breakout
from marketloom.plans import breakout as plans, market

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in market._queries.items() if f.__module__ == plans.__name__]


def _ordered(frame):
    tidy = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v
    return sorted((tuple(tidy(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            duck.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    theirs = _ordered(duck.sql(market.oracle_sql()[name]).df().astype(object))
    assert _ordered(market._queries[name](spark, SF).toPandas().astype(object)) == theirs


def test_weights_are_the_seeded_smoothing():
    values = np.random.default_rng(1).random(288)
    now = values[:14].mean()
    for v in values[14:]:
        now = (13 * now + v) / 14
    assert breakout.seeded_weights(288) @ values == pytest.approx(now, rel=1e-12)


def test_positions_end_by_the_first_reason(spark):
    schema = "symbol string, seg long, open_time_ms long, open double, close double, side int, atr double, upper double, lower double"
    up = lambda t, close, side=None: ("a", 1, t, 100.0, close, side, 1.0, 99.5, 90.0)
    down = lambda t, close, side=None: ("b", 1, t, 100.0, close, side, 1.0, 110.0, 100.4)
    rows = [up(0, 100.0, 1), up(1, 99.6), up(2, 103.0, 1), up(3, 99.5, 1), up(4, 99.2), down(0, 100.0, -1), down(1, 100.3), down(2, 100.2, -1), down(3, 100.1)]
    x = spark.createDataFrame(rows, schema)
    got = {(r["symbol"], r["open_time_ms"]): (r["reason"], r["held"]) for r in breakout.exits(x, "side", 3).collect()}
    assert got == {("a", 0): ("PROFIT_CLOSE", 2), ("a", 2): ("STRUCTURE_FAILURE", 1), ("a", 3): ("ADVERSE_CLOSE", 1), ("b", 0): ("HARD_HORIZON", 3), ("b", 2): ("KEEP", 1)}
    assert breakout.exits(x.limit(0), "side").count() == 0
