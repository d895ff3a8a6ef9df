"""Volume-price confirmation, reasons why volume features are missing, and directional filters.

Bars: symbol, open_time_ms, close_time_ms, open, high, low, close, quote_volume,
taker_quote and is_closed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import smooth
from .series import full, key, last, segment, true_range, with_segments

# Rows of the short, long, signal and slope windows of the confirmation, and of the taker delta.
SHORT, LONG, SIGNAL, SLOPE = 5, 20, 5, 3
TAKER_SHORT, TAKER_LONG = 3, 12


def boundaries_hold(step_ms: int) -> Column:
    """A closed bar whose close time is that of its open and step; nulls do not hold."""
    ok = F.col("is_closed") & (F.col("open_time_ms") >= 0) & (F.col("close_time_ms") == F.col("open_time_ms") + (step_ms - 1))
    return F.coalesce(ok, F.lit(False))


def _amount(column: str) -> Column:
    """Finite and not negative."""
    return (F.col(column) >= 0) & (F.col(column) < F.lit(float("inf"))) & ~F.isnan(column)


def flow_valid(step_ms: int) -> Column:
    ok = boundaries_hold(step_ms) & _amount("quote_volume") & _amount("taker_quote") & (F.col("taker_quote") <= F.col("quote_volume"))
    return F.coalesce(ok, F.lit(False))


def price_valid(step_ms: int) -> Column:
    ok = boundaries_hold(step_ms) & _amount("quote_volume")
    for c in ("open", "high", "low", "close"):
        ok = ok & (F.col(c) > 0) & _amount(c)
    ok = ok & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return F.coalesce(ok, F.lit(False))


def confirmation(bars: DataFrame, step_ms: int) -> DataFrame:
    """Bars with ``vpci``, its volume-weighted ``vpci_signal`` and its change ``vpci_slope``; all three or none.

    Long volume-weighted mean less long mean, times short weighted mean over
    short mean, times short over long mean volume, in mean true ranges.  Windows
    stay in contiguous runs of valid bars; other bars have nulls.
    """
    judged = bars.withColumn("_valid", price_valid(step_ms))
    x = with_segments(judged.where("_valid"), step_ms)
    x = x.withColumns({"_tr": true_range(), "_cq": F.col("close") * F.col("quote_volume")})
    volume = {n: F.sum("quote_volume").over(last(n)) for n in (SHORT, LONG)}
    weighted = {n: F.sum("_cq").over(last(n)) / volume[n] for n in (SHORT, LONG)}
    plain = {n: F.avg("close").over(last(n)) for n in (SHORT, LONG)}
    atr = F.avg("_tr").over(last(LONG))
    value = (weighted[LONG] - plain[LONG]) * (weighted[SHORT] / plain[SHORT]) * (volume[SHORT] / SHORT) / (volume[LONG] / LONG) / atr
    x = x.withColumn("_v", full(F.when((volume[LONG] > 0) & (volume[SHORT] > 0) & (atr > 0), value), last(LONG), LONG))
    five = F.sum("quote_volume").over(last(SIGNAL))
    signal = F.when((F.count("_v").over(last(SIGNAL)) == SIGNAL) & (five > 0), F.sum(F.col("_v") * F.col("quote_volume")).over(last(SIGNAL)) / five)
    x = x.withColumns({"_s": signal, "_d": F.col("_v") - F.lag("_v", SLOPE).over(segment())})
    whole = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    out = {"vpci": "_v", "vpci_signal": "_s", "vpci_slope": "_d"}
    x = x.select(*bars.columns, *(F.when(whole, F.col(c)).alias(n) for n, c in out.items()))
    rest = judged.where("not _valid").select(*bars.columns, *(F.lit(None).cast("double").alias(n) for n in out))
    return x.unionByName(rest)


def missing_reasons(bars: DataFrame, step_ms: int) -> DataFrame:
    """Adds ``taker_reason`` and ``vpci_reason``: why the feature is missing at a bar, the first that applies, or null.

    immature_window, unclosed_candle, invalid_candle_boundary,
    invalid_feature_input, noncontiguous_window, zero_quote_volume_denominator,
    zero_atr.  Windows are of rows, whatever is between them.
    """
    w = key()
    rows = lambda n: w.rowsBetween(-(n - 1), 0)
    before = F.lag("close").over(w)
    x = bars.withColumns(
        {
            "_open": ~F.coalesce("is_closed", F.lit(False)), "_edge": ~boundaries_hold(step_ms), "_flow": ~flow_valid(step_ms), "_price": ~price_valid(step_ms),
            "_gap": F.coalesce(F.col("open_time_ms") - F.lag("open_time_ms").over(w) != step_ms, F.lit(False)),
            "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
            **{f"_q{n}": F.sum("quote_volume").over(rows(n)) for n in (TAKER_SHORT, TAKER_LONG, SHORT, LONG)},
        }
    )
    x = x.withColumn("_atr", full(F.avg("_tr").over(rows(LONG)), rows(LONG), LONG))
    x = x.withColumns({"_dry": (F.col(f"_q{LONG}") <= 0) | (F.col(f"_q{SHORT}") <= 0), "_still": F.coalesce(F.col("_atr") <= 0, F.lit(True))})

    def reason(n: int, invalid: str, dry: Column, still: Column | None) -> Column:
        any_of = lambda c, k: F.max(c).over(rows(k))
        out = F.when(F.count(F.lit(1)).over(rows(n)) < n, "immature_window").when(any_of("_open", n), "unclosed_candle")
        out = out.when(any_of("_edge", n), "invalid_candle_boundary").when(any_of(invalid, n), "invalid_feature_input")
        out = out.when(any_of("_gap", n - 1), "noncontiguous_window").when(dry, "zero_quote_volume_denominator")
        return out if still is None else out.when(still, "zero_atr")

    need = LONG + max(SIGNAL - 1, SLOPE)
    taker = reason(TAKER_LONG, "_flow", (F.col(f"_q{TAKER_LONG}") <= 0) | (F.col(f"_q{TAKER_SHORT}") <= 0), None)
    vpci = reason(need, "_price", F.max("_dry").over(rows(SIGNAL)), F.max("_still").over(rows(SIGNAL)))
    return x.select(*bars.columns, taker.alias("taker_reason"), vpci.alias("vpci_reason"))


def directional_filters(rows: DataFrame) -> DataFrame:
    """Adds the filters of a direction (1 or -1) from indicators that are known at the bar.

    Reads direction, plus_di, minus_di, macd_histogram, macd_before, atr,
    taker_delta_3, taker_imbalance, range_ratio and volume_ratio.  The taker
    delta falls back to the bar's own imbalance, and its source says so.
    """
    d = F.col("direction")
    spread = d * (F.col("plus_di") - F.col("minus_di"))
    total = F.col("plus_di") + F.col("minus_di")
    source = F.when(F.col("taker_delta_3").isNotNull(), "taker_delta_3").when(F.col("taker_imbalance").isNotNull(), "current_taker_imbalance").otherwise("unavailable")
    return rows.withColumns(
        {
            "di_spread": spread, "di_balance": F.when(total == 0, F.lit(0.0)).otherwise(spread / total),
            "macd_delta_atr": F.when(F.col("atr") > 0, d * (F.col("macd_histogram") - F.col("macd_before")) / F.col("atr")),
            "directional_taker_delta": d * F.coalesce("taker_delta_3", "taker_imbalance"), "taker_delta_source": source,
            "range_contraction": 1 - F.col("range_ratio"), "volume_contraction": 1 - F.col("volume_ratio"),
        }
    )


#: Periods of the hourly trend.
FAST, SLOW, RANGE = 24, 96, 96
TREND_NAMES = ["fast", "slow", "range", "trend"]
TREND_RUN_IN = math.ceil(math.log(1e-12) / math.log(1 - 1 / RANGE))


def trend(bars: pd.DataFrame) -> pd.DataFrame:
    """Kernel: EMA 24 less EMA 96 in ATR 96 of one series in time order."""
    c, h, low = (bars[x].to_numpy(float) for x in ("close", "high", "low"))
    before = np.concatenate([[np.nan], c[:-1]])
    tr = np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))
    out = {"fast": smooth(c, FAST, 2 / (FAST + 1)), "slow": smooth(c, SLOW, 2 / (SLOW + 1)), "range": smooth(tr, RANGE, 1 / RANGE)}
    with np.errstate(all="ignore"):
        out["trend"] = np.where(out["range"] > 0, (out["fast"] - out["slow"]) / out["range"], np.nan)
    return pd.DataFrame(out, index=bars.index)
