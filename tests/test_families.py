import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from marketloom.operators import families, kernels, volume
from marketloom.plans import families as plans, market

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


def _bars(spark, n, change=None):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        c = 100 + float(rng.normal())
        row = {"symbol": "s", "open_time_ms": 10 * i, "close_time_ms": 10 * i + 9, "open": c, "high": c + 1, "low": c - 1, "close": c, "quote_volume": float(rng.integers(1, 9)), "taker_quote": 1.0, "is_closed": True}
        rows.append(row | (change or {}).get(i, {}))
    return spark.createDataFrame(pd.DataFrame(rows), "symbol string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, quote_volume double, taker_quote double, is_closed boolean")


def test_confirmation_by_hand_and_reasons_agree(spark):
    changes = {30: {"is_closed": None}, 60: {"high": 1.0}, 90: {"quote_volume": float("nan")}, 120: {"taker_quote": 99.0}}
    bars = _bars(spark, 150, changes)
    got = {r["open_time_ms"] // 10: r for r in volume.confirmation(bars, 10).collect()}
    why = {r["open_time_ms"] // 10: r for r in volume.missing_reasons(bars, 10).collect()}
    assert len(got) == len(why) == 150
    # a value is missing just where there is a reason
    assert {i for i, r in got.items() if r["vpci"] is None} == {i for i, r in why.items() if r["vpci_reason"] is not None}
    assert why[0]["vpci_reason"] == "immature_window" and why[30]["vpci_reason"] == "unclosed_candle" and why[60]["vpci_reason"] == why[90]["vpci_reason"] == "invalid_feature_input"
    assert why[120]["vpci_reason"] is None and why[120]["taker_reason"] == "invalid_feature_input" and why[132]["taker_reason"] is None
    b = bars.toPandas()

    def value(i):
        a, s = b[i - 19 : i + 1], b[i - 4 : i + 1]
        before = b.close.to_numpy()[i - 20 : i]
        tr = np.maximum(a.high - a.low, np.maximum(np.abs(a.high - before), np.abs(a.low - before))).mean()
        mean = lambda x: (x.close * x.quote_volume).sum() / x.quote_volume.sum()
        return (mean(a) - a.close.mean()) * mean(s) / s.close.mean() * s.quote_volume.mean() / a.quote_volume.mean() / tr

    q = b.quote_volume.to_numpy()[141:146]
    assert got[145]["vpci"] == pytest.approx(value(145)) and got[145]["vpci_slope"] == pytest.approx(value(145) - value(142))
    assert got[145]["vpci_signal"] == pytest.approx(sum(value(i) * v for i, v in zip(range(141, 146), q)) / q.sum())


def test_trend_is_the_same_in_one_chunk_and_in_many(spark):
    bars = _bars(spark, 6000).selectExpr("symbol", "1L as seg", "open_time_ms", "high", "low", "close")
    run = lambda chunk: {r["open_time_ms"]: r["trend"] for r in kernels.recursive_series(bars, chunk, volume.TREND_RUN_IN, volume.trend, volume.TREND_NAMES).collect()}
    one, many = run(10_000), run(2_700)
    assert [t for t, v in one.items() if v is not None] and all((v is None) == (many[t] is None) and (v is None or many[t] == pytest.approx(v)) for t, v in one.items())
    assert min(t for t, v in one.items() if v is not None) == 950


SCHEMA = "slot long, family string, direction int, strength_micros long, readiness string, closed boolean, causal boolean, close_ms long, cutoff_ms long, event_ms long, receipt_ms long"


def _slot(spark, *slots):
    rows = []
    for slot, (votes, changes) in enumerate(slots):
        for family, (direction, strength) in zip(families.DIRECTIONAL + families.CONTEXT, votes):
            row = {"slot": slot, "family": family, "direction": direction, "strength_micros": strength, "readiness": "READY", "closed": True, "causal": True, "close_ms": 100, "cutoff_ms": 200, "event_ms": 110, "receipt_ms": 150}
            rows.append(row | changes.get(family, {}))
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_scores_and_panels_of_hand_made_slots(spark):
    up, down, flat = (1, 900_000), (-1, 900_000), (0, 0)
    price, flow, volatility = families.DIRECTIONAL[0], families.DIRECTIONAL[1], families.CONTEXT[0]
    x = _slot(
        spark, ([up] * 5 + [flat], {}), ([down] * 6, {}), ([up] * 3 + [flat] * 3, {}), ([down, down, flat, flat, flat, down], {}), ([up] * 6, {volatility: {"readiness": "FEATURE_NOT_READY"}}),
        ([up] * 6, {price: {"receipt_ms": 201}, flow: {"event_ms": 99}}), ([up] * 6, {price: {"causal": False}}), ([(1, 5), flat, flat, flat, flat, (-1, 8)], {}),
    )
    got = {r["slot"]: r for r in families.evidence_score(x, ["slot"]).collect()}
    assert [got[i]["bias"] for i in range(8)] == ["BULLISH_STRONG", "BEARISH_STRONG", "BULLISH_LEAN", "BEARISH_LEAN", "NOT_AVAILABLE", "NOT_AVAILABLE", "NOT_AVAILABLE", "NEUTRAL"]
    assert (got[0]["score_micros"], got[0]["neutral"], got[7]["score_micros"]) == (750_000, 1, -1)
    assert [got[i]["status"] for i in (4, 5, 6)] == ["FEATURE_NOT_READY", "DATA_INVALID", "INCONCLUSIVE_DATA"]
    assert got[5]["reasons"] == f"PRECLOSE_EVENT_FORBIDDEN:{flow},LATE_RECEIPT_FORBIDDEN:{price}"
    panel = {r["slot"]: r for r in families.directional_panel(x, ["slot"]).collect()}
    assert [panel[i]["state"] for i in range(8)] == ["BROAD_BULLISH_STATE", "BROAD_BEARISH_STATE", "BROAD_BULLISH_STATE", "BEARISH_STATE_TILT", "BROAD_BULLISH_STATE", "WITHHELD", "WITHHELD", "MIXED_OR_NEUTRAL_STATE"]
    assert (panel[4]["context_withheld"], panel[5]["status"], panel[7]["agreement_micros"]) == (volatility, "DATA_INVALID", 2)
    assert families.evidence_score(x.limit(0), ["slot"]).count() == families.directional_panel(x.limit(0), ["slot"]).count() == 0


def test_registration_finds_missing_conflicting_and_shared(spark):
    every = [(1, f, f"src{i}", 1) for i, f in enumerate(families.DIRECTIONAL + families.CONTEXT)]
    more = [(1, families.DIRECTIONAL[0], "src0", 1), (2, families.DIRECTIONAL[0], "a", 1), (2, families.DIRECTIONAL[0], "a", 2), (2, families.DIRECTIONAL[1], "a", 1), (3, None, None, 1)]
    x = spark.createDataFrame(every + more, "slot long, family string, source string, strength int")
    got = sorted(tuple(r) for r in families.registered(x, ["slot"], "family", "source", ["strength"]).collect())
    assert got == [(1, 0, 0, 0, True), (2, 4, 1, 1, False), (3, 6, 1, 0, False)]
