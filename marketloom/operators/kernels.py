"""Recursive smoothers as grouped-map kernels.

A series is a symbol's contiguous segment.  Long series are cut in chunks with
a run-in: a smoother forgets its start, so a chunk that begins ``run_in`` rows
early agrees with the whole series to 1e-12.  One long key is thus many groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 50_000


def smooth(values: np.ndarray, period: int, alpha: float, seeded: bool = True) -> np.ndarray:
    """Exponential smoothing from the mean of the first ``period`` values (or, unseeded, from the first)."""
    out = np.full(len(values), np.nan)
    if len(values) < period:
        return out
    now = values[:period].mean() if seeded else values[0]
    at = period - 1
    out[at] = now
    for i in range(at + 1, len(values)):
        now += alpha * (values[i] - now)
        out[i] = now
    return out


def _after_gap(values: np.ndarray, period: int, alpha: float) -> np.ndarray:
    """``smooth`` over the values that are there; others stay missing."""
    out = np.full(len(values), np.nan)
    there = ~np.isnan(values)
    out[there] = smooth(values[there], period, alpha)
    return out


def indicators(bars: pd.DataFrame) -> pd.DataFrame:
    """EMA 9/20/50/200, RSI 14, ATR 14, +DI, -DI and ADX 14 and MACD histogram of one series in time order."""
    c, h, low = (bars[x].to_numpy(float) for x in ("close", "high", "low"))
    out = {f"ema{p}": smooth(c, p, 2 / (p + 1)) for p in (9, 20, 50, 200)}
    before = np.concatenate([[np.nan], c[:-1]])
    tr = np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))
    trs = smooth(tr, 14, 1 / 14)
    move = np.diff(c)
    gain, loss = (np.concatenate([[np.nan], smooth(np.maximum(s * move, 0), 14, 1 / 14)])[: len(c)] for s in (1, -1))
    with np.errstate(all="ignore"):
        out["rsi"] = np.where(np.isnan(gain), np.nan, np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss)))
        up, down = np.diff(h, prepend=h[:1]), -np.diff(low, prepend=low[:1])
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        p, m = 100 * smooth(plus, 14, 1 / 14) / trs, 100 * smooth(minus, 14, 1 / 14) / trs
        dx = np.where(trs > 0, np.where(p + m == 0, 0.0, 100 * np.abs(p - m) / (p + m)), np.nan)
    out["atr"] = trs
    out["plus_di"], out["minus_di"] = p, m
    out["adx"] = _after_gap(dx, 14, 1 / 14)
    macd = smooth(c, 12, 2 / 13) - smooth(c, 26, 2 / 27)
    out["macd_histogram"] = macd - _after_gap(macd, 9, 0.2)
    return pd.DataFrame(out, index=bars.index)


NAMES = ["ema9", "ema20", "ema50", "ema200", "rsi", "atr", "plus_di", "minus_di", "adx", "macd_histogram"]
RUN_IN = math.ceil(math.log(1e-12) / math.log(1 - 2 / 201))


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str, bucket: int | None = None) -> DataFrame:
    """Adds ``name``: the row's number from 0 in its key's order.

    With ``bucket``, the width of a step of the first order column (a number),
    rows are sorted within key and bucket and the counts of earlier buckets are
    added, so no task sorts a whole key.  Rows without that number come first.
    """
    if bucket is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    part = [*keys, "_bucket"]
    x = rows.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(*part).agg(F.count("*").alias("_n"))
    counts = counts.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    x = x.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    match = F.lit(True)
    for c in part:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}"))
    x = x.alias("x").join(counts.alias("c"), match)
    return x.select(*(F.col(f"x.`{c}`") for c in rows.columns), (F.col("_at") + F.col("_before")).alias(name))


#: Step of time in which rows of a series are counted before they are cut in chunks.
COUNT_MS = 1000 * 86_400_000


def recursive_series(
    segments: DataFrame, chunk_rows: int = CHUNK_ROWS, run_in: int = RUN_IN,
    kernel: Callable[[pd.DataFrame], pd.DataFrame] = indicators, results: list[str] | None = None,
) -> DataFrame:
    """Adds the recursive indicators, or ``results`` of another ``kernel``, to bars with ``symbol``, ``seg`` and ``open_time_ms``.

    Causal: a row depends on earlier rows of its segment only.  Short segments
    give nulls until the smoothers are seeded.  ``run_in`` is at most ``chunk_rows``.
    """
    if run_in > chunk_rows:
        raise ValueError("run_in must not exceed chunk_rows")
    own = F.floor(F.col("rn") / chunk_rows).cast("int")
    numbered = placed(segments, ["symbol", "seg"], ["open_time_ms"], "rn", COUNT_MS)
    needed = F.when((F.col("rn") + run_in) / chunk_rows >= own + 1, F.array(own, own + 1)).otherwise(F.array(own))
    chunks = numbered.withColumn("own", own).withColumn("chunk", F.explode(needed))
    names = list(segments.columns)
    fields = ", ".join(f"{c} {t}" for c, t in segments.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("open_time_ms", kind="stable")
        found = pd.concat([group[names], kernel(group)], axis=1)
        return found[(group["own"] == group["chunk"]).to_numpy()].replace({np.nan: None})

    return chunks.groupBy("symbol", "seg", "chunk").applyInPandas(run, fields + "".join(f", {n} double" for n in results or NAMES))
