"""Breakouts from compression: metrics of a bar against its prior window, gates, a cheap prefilter and exits.

Bars: symbol, seg (contiguous run), open_time_ms, open, high, low, close,
quote_volume and taker_quote.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import COUNT_MS, recursive_series
from .records import sorted_window
from .series import prior, segment, true_range

# Rows of the windows, bounds of the gates, and multiples of the range at which a position ends.
WINDOW, CHANNEL, ATR_PERIOD, SHORT, BASE, HORIZON = 288, 24, 14, 12, 72, 24
COMPRESSION_MAX, EXPANSION_MIN, EXPANSION_MAX, ATR_FRACTION_MIN = 0.70, 1.50, 3.00, 0.0035
BREAKOUT_MIN, BREAKOUT_MAX, LOCATION_MIN = 0.10, 0.50, 0.75
USUAL_VOLUME_MIN, IMBALANCE_MIN, ROBUST_Z_MIN, ACTIVITY_MIN = 100_000, 0.20, 2.00, 2.00
PREFILTER_VOLUME_MIN = 200_000
ADVERSE_ATR, PROFIT_ATR = 0.80, 3.00
MAD_SCALE = 1.4826


def seeded_weights(n: int, period: int = ATR_PERIOD) -> np.ndarray:
    """What each of ``n`` true ranges, oldest first, weighs in a smoothed range that begins with their first ``period``."""
    kept = 1 - 1 / period
    ages = np.arange(n - 1, -1, -1)
    return np.where(np.arange(n) < period, kept ** (n - period), kept**ages) / period


def metrics(bars: DataFrame, n: int = WINDOW) -> DataFrame:
    """Bars with the metrics of a breakout and ``status``: READY or the first reason why there are none.

    The range is smoothed over exactly the ``n`` prior bars (at least 72), so it
    is a weighted sum, taken in chunks that begin ``n`` + 1 rows early.
    """
    if n < BASE:
        raise ValueError(f"n must be at least {BASE}")
    weights = seeded_weights(n)

    def smoothed(group: pd.DataFrame) -> pd.DataFrame:
        c, h, low = (group[x].to_numpy(float) for x in ("close", "high", "low"))
        before = np.concatenate([[np.nan], c[:-1]])
        tr = np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before)))
        out = np.full(len(c), np.nan)
        if len(c) > n + 1:
            out[n + 1 :] = np.correlate(tr[1:], weights, "valid")[: len(c) - n - 1]
        return pd.DataFrame({"atr": out}, index=group.index)

    w = segment()
    own = F.when(F.col("quote_volume") != 0, 2 * F.col("taker_quote") / F.col("quote_volume") - 1)
    x = recursive_series(bars, run_in=n + 1, kernel=smoothed, results=["atr"])
    x = x.withColumns({"_tr": true_range(), "imbalance": own, "_taken": F.coalesce(own, F.lit(0.0)), "previous_close": F.lag("close").over(w)})
    x = x.withColumns(
        {
            "_recent": F.percentile("_tr", F.lit(0.5)).over(prior(SHORT)), "_base": F.percentile("_tr", F.lit(0.5)).over(w.rowsBetween(-BASE, -SHORT - 1)),
            "upper": F.max("high").over(prior(CHANNEL)), "lower": F.min("low").over(prior(CHANNEL)), "_least": F.min("quote_volume").over(prior(n)),
        }
    )
    for column, names in (("quote_volume", ("usual_volume", "_unused")), ("_taken", ("_center", "_mad"))):
        x = sorted_window(x, ["symbol", "seg"], ["open_time_ms"], column, n, bucket=COUNT_MS).withColumnsRenamed(dict(zip(("prior_median", "prior_mad"), names))).drop("prior_ecdf")
    zero = {
        "ZERO_ATR14": F.col("atr") == 0, "ZERO_COMPRESSION_BASELINE_MEDIAN": F.col("_base") == 0, "ZERO_PRIOR_QUOTE_VOLUME_DENOMINATOR": F.col("_least") == 0,
        "ZERO_CURRENT_QUOTE_VOLUME": F.col("quote_volume") == 0, "ZERO_CURRENT_HIGH_LOW_RANGE": F.col("high") == F.col("low"), "ZERO_TAKER_IMBALANCE_MAD": F.col("_mad") == 0,
    }
    status = F.when(F.col("atr").isNull(), "CALCULATION_BAR_COUNT_NOT_COMPLETE")
    for name, c in zero.items():
        status = status.when(c, name)
    x = x.withColumn("status", status.otherwise("READY"))
    ready = lambda c: F.when(F.col("status") == "READY", c)
    width, atr, c = F.col("high") - F.col("low"), F.col("atr"), F.col("close")
    x = x.withColumns(
        {
            "compression": ready(F.col("_recent") / F.col("_base")), "expansion": ready(F.col("_tr") / atr), "atr_fraction": ready(atr / F.col("previous_close")), "activity": ready(F.col("quote_volume") / F.col("usual_volume")),
            "imbalance_rz": ready((F.col("imbalance") - F.col("_center")) / (MAD_SCALE * F.col("_mad"))), "long_breakout": ready((c - F.col("upper")) / atr), "short_breakout": ready((F.col("lower") - c) / atr),
            "long_location": ready((c - F.col("low")) / width), "short_location": ready((F.col("high") - c) / width),
        }
    )
    return x.drop("_tr", "_taken", "_recent", "_base", "_least", "_unused", "_center", "_mad")


def gates(rows: DataFrame) -> DataFrame:
    """Adds ``long_failures``, ``short_failures`` (joined by commas) and ``entry`` (1, -1 or null) to READY rows of ``metrics``.

    Reads the trend of the last completed hour as hour_close, hour_ema20 and
    hour_ema50; without it the trend gate fails.
    """
    col, close, fast, slow = F.col, F.col("hour_close"), F.col("hour_ema20"), F.col("hour_ema50")
    shared = [
        ("COMPRESSION_GT_0_70", col("compression") > COMPRESSION_MAX), ("CURRENT_EXPANSION_LT_1_50", col("expansion") < EXPANSION_MIN), ("CURRENT_EXPANSION_GT_3_00", col("expansion") > EXPANSION_MAX),
        ("ATR_FRACTION_LT_0_0035", col("atr_fraction") < ATR_FRACTION_MIN), ("PRIOR_MEDIAN_QUOTE_VOLUME_LT_100000", col("usual_volume") < USUAL_VOLUME_MIN), ("ACTIVITY_LT_2_00", col("activity") < ACTIVITY_MIN),
    ]

    def failures(side: str, crossed: Column, trend: Column, flow: Column, z: Column, sign: str) -> Column:
        move, place = col(f"{side.lower()}_breakout"), col(f"{side.lower()}_location")
        asked = [
            (f"{side}_FIRST_CROSS_FAILED", crossed), (f"{side}_BREAKOUT_ATR_LT_0_10", move < BREAKOUT_MIN), (f"{side}_BREAKOUT_ATR_GT_0_50", move > BREAKOUT_MAX), (f"{side}_CLOSE_LOCATION_LT_0_75", place < LOCATION_MIN),
            (f"{side}_STRICT_PRIOR_HOURLY_TREND_FAILED", ~F.coalesce(trend, F.lit(False))), *shared, (f"{side}_TAKER_IMBALANCE_{sign}0_20", flow), (f"{side}_TAKER_ROBUST_Z_{sign}2_00", z),
        ]
        return F.when(col("status") == "READY", F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in asked))), ","))

    long = failures("LONG", col("previous_close") > col("upper"), (close > fast) & (fast > slow), col("imbalance") < IMBALANCE_MIN, col("imbalance_rz") < ROBUST_Z_MIN, "LT_")
    short = failures("SHORT", col("previous_close") < col("lower"), (close < fast) & (fast < slow), col("imbalance") > -IMBALANCE_MIN, col("imbalance_rz") > -ROBUST_Z_MIN, "GT_NEG_")
    x = rows.withColumns({"long_failures": long, "short_failures": short})
    return x.withColumn("entry", F.when(F.col("long_failures") == "", 1).when(F.col("short_failures") == "", -1))


def prefilter(bars: DataFrame) -> DataFrame:
    """Adds ``prefilter`` and ``prefilter_reasons``: what must hold of a bar and its prior channel before metrics are worth their cost."""
    col = F.col
    x = bars.withColumns({"_upper": F.max("high").over(prior(CHANNEL)), "_lower": F.min("low").over(prior(CHANNEL)), "_rows": F.count(F.lit(1)).over(prior(CHANNEL))})
    joined = lambda *cases: F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in cases))), ",")
    invalid = joined(("PRIOR_CHANNEL_NOT_CONTIGUOUS", col("_rows") < CHANNEL), ("ZERO_CURRENT_QUOTE_VOLUME", col("quote_volume") <= 0), ("ZERO_CURRENT_HIGH_LOW_RANGE", col("high") == col("low")))
    flow, width = F.try_divide(2 * col("taker_quote") - col("quote_volume"), col("quote_volume")), col("high") - col("low")
    little = ("CURRENT_QUOTE_VOLUME_LT_200000", col("quote_volume") < PREFILTER_VOLUME_MIN)
    long = joined(little, ("LONG_TAKER_IMBALANCE_LT_0_20", flow < IMBALANCE_MIN), ("LONG_CLOSE_LOCATION_LT_0_75", F.try_divide(col("close") - col("low"), width) < LOCATION_MIN))
    short = joined(little, ("SHORT_TAKER_IMBALANCE_GT_NEG_0_20", flow > -IMBALANCE_MIN), ("SHORT_CLOSE_LOCATION_LT_0_75", F.try_divide(col("high") - col("close"), width) < LOCATION_MIN))
    x = x.withColumns({"_bad": invalid, "_side": F.when(col("close") > col("_upper"), "LONG").when(col("close") < col("_lower"), "SHORT"), "_fails": F.when(col("close") > col("_upper"), long).otherwise(short)})
    status = F.when(col("_bad") != "", "INVALID_INPUT_INCONCLUSIVE").when(col("_side").isNull() | (col("_fails") != ""), "NECESSARY_GATE_FALSE").otherwise(F.concat(F.lit("CANDIDATE_"), "_side"))
    reasons = F.when(col("_bad") != "", col("_bad")).when(col("_side").isNull(), "NO_STRICT_PRIOR_CHANNEL_BREAKOUT").when(col("_fails") != "", col("_fails")).otherwise(F.concat("_side", F.lit("_NECESSARY_GATES_PASS")))
    return x.select(*bars.columns, status.alias("prefilter"), reasons.alias("prefilter_reasons"))


def exits(rows: DataFrame, side: str, horizon: int = HORIZON) -> DataFrame:
    """Adds ``reason`` and ``held``: how and after how many bars a position of ``side``, entered at the next open, ends.

    At each close in order: adverse by 0.8 ranges, back inside the channel,
    profit of 3 ranges, then the last bar of the horizon.  Range and channel are
    those of the signal's bar.  KEEP where the run ends before; null without a side.
    """
    d, atr = F.col(side), F.col("atr")
    entry = F.lead("open").over(segment())
    path = F.collect_list("close").over(segment().rowsBetween(1, horizon))  # never over ``horizon`` values
    x = rows.withColumns({"_entry": entry, "_path": path, "_edge": F.when(d > 0, F.col("upper")).otherwise(F.col("lower"))}).where(d.isNotNull())

    def step(close: Column, i: Column) -> Column:
        reason = F.when(d * (close - (F.col("_entry") - d * ADVERSE_ATR * atr)) <= 0, "ADVERSE_CLOSE").when(d * (close - F.col("_edge")) <= 0, "STRUCTURE_FAILURE")
        reason = reason.when(d * (close - (F.col("_entry") + d * PROFIT_ATR * atr)) >= 0, "PROFIT_CLOSE").when(i == horizon - 1, "HARD_HORIZON")
        return F.struct((i + 1).alias("held"), reason.alias("reason"))

    first = F.get(F.filter(F.transform("_path", step), lambda s: s["reason"].isNotNull()), 0)
    x = x.withColumn("_first", first)
    return x.withColumns({"reason": F.coalesce("_first.reason", F.lit("KEEP")), "held": F.coalesce("_first.held", F.size("_path"))}).drop("_entry", "_path", "_edge", "_first")
