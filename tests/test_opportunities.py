import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from marketloom.operators import opportunities
from marketloom.plans import market, opportunities as plans

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


def test_outcomes_of_a_hand_made_series(spark):
    # bars of 10 ms; one is missing between 90 and 110
    times = [t for t in range(0, 200, 10) if t != 100]
    bars = spark.createDataFrame([("s", t, t + 9, 100.0 + t, 101.0 + t, 99.0 + t, 100.0 + t, -1 if t == 30 else 1) for t in times], "symbol string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, direction int")
    plan = opportunities.Plan(horizons=(2,), technical=3, embargo=1, fee_bps=0.0, slippage_bps=0.0)
    splits = [opportunities.Split("a", 20, 80), opportunities.Split("b", 120, 200)]
    paid = spark.createDataFrame([("s", 40, 0.5, 10.0), ("s", 45, 0.1, 280.0), ("s", 50, 0.25, None), ("s", 59, 7.0, 1.0)], "symbol string, funding_time_ms long, rate double, mark_price double")
    got = {(r["open_time_ms"], r["horizon"]): r for r in opportunities.opportunities(bars, splits, 10, plan, paid, 7).collect()}
    assert len(got) == 2 * len(times)
    why = {t: got[t, 2]["exclusion"] for t in times}
    assert why == {0: "outside_declared_split", 10: "split_start_embargo", 20: None, 30: None, 40: None, 50: None, 60: "horizon_crosses_split", 70: "outside_declared_split", 80: "data_gap_in_horizon", 90: "data_gap_in_horizon", 110: "split_start_embargo", 120: None, 130: None, 140: None, 150: None, 160: None, 170: None, 180: "insufficient_2_bar_horizon", 190: "insufficient_2_bar_horizon"}
    # entered at 40 for 140, left at the close of the bar at 50, at 59: payments at 45 and 50 count
    r = got[30, 2]
    fund = 0.1 * 280 / 140 + 0.25
    assert (r["entry"], r["exit"]) == (140.0, 150.0) and r["long_net"] == pytest.approx(10 / 140 - fund) and r["short_net"] == pytest.approx(-10 / 140 + fund)
    assert r["label"] == "SHORT" and r["net_return"] == pytest.approx(r["short_net"]) and r["funding_return"] == pytest.approx(fund)
    t = got[140, 3]
    assert t["exclusion"] is None and t["net_return"] is None and (t["mfe"], t["mae"]) == (pytest.approx((271 - 250) / 250 + 0.0), pytest.approx(-1 / 250)) and got[160, 3]["exclusion"] == "insufficient_3_bar_horizon"
    assert got[0, 2]["split"] == "outside" and opportunities.opportunities(bars.limit(0), splits, 10, plan).count() == 0
