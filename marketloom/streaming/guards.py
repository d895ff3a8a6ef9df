"""Stateful guards of live feeds: one keyed operator each, its state a few numbers or a bounded ring.

Rows carry ``arrival``, a number that grows with their receipt; a micro-batch
is taken in that order within each key.  State expires by event time once no
row could still be compared with it.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HORIZON_S = 30
MIN_RETURN = 0.015
MIN_ZSCORE = 4.0
MIN_POINTS = 20
HISTORY_POINTS = 600
#: Rows that a guard hands back at a time.
OUT_ROWS = 50_000
#: Families and directions of the two rows of an observation.
FAMILIES = (("PUMP_RISK", "RISK_UP"), ("CRASH_RISK", "RISK_DOWN"))


def _stateful(rows: DataFrame, keys: list[str], step: Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple, int]], output: str, state: str, time: str, delay: str, keep_ms: int) -> DataFrame:
    """``step`` (rows in order of arrival, state) -> (output, state, last event time) for each key and micro-batch.

    The state goes ``keep_ms`` of event time after the key's last row.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        arrived = pd.concat(list(frames)).sort_values("arrival", kind="stable", ignore_index=True)
        out, after, last = step(arrived, group.get if group.exists else None)
        if after is not None:
            group.update(after)
            group.setTimeoutTimestamp(max(last + keep_ms, group.getCurrentWatermarkMs() + 1))
        for i in range(0, max(len(out), 1), OUT_ROWS):
            yield out.iloc[i : i + OUT_ROWS].assign(**dict(zip(keys, key, strict=True)))[names]

    names = [f.strip().split(" ")[0] for f in output.split(",")]
    timed = rows.withColumn("_time", F.timestamp_millis(time)).withWatermark("_time", delay)
    return timed.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def anomaly(times: list[int], prices: list[float], horizon_s: int, min_return: float, min_zscore: float, min_points: int) -> tuple[float, float] | None:
    """Return over the horizon and its robust z-score where both reach their bounds at the last point."""
    if len(times) < min_points:
        return None
    target = times[-1] - horizon_s * 1000
    at = bisect_left(times, target)  # of the nearest points the earliest
    if at == len(times) or at and target - times[at - 1] <= times[at] - target:
        at -= 1
    if times[at] > target + 5_000:
        return None
    change = prices[-1] / prices[at] - 1
    if abs(change) < min_return:
        return None
    steps = np.diff(np.log(prices))
    sigma = max(1.4826 * float(np.median(np.abs(steps - np.median(steps)))), 1e-9)
    zscore = abs(math.log(prices[-1] / prices[at])) / (sigma * math.sqrt(max(1, horizon_s)))
    return (change, zscore) if zscore >= min_zscore else None


def evaluated(
    arrival: np.ndarray, t: np.ndarray, p: np.ndarray, times: list[int], prices: list[float],
    window: int, history: int, horizon_s: int, min_return: float, min_zscore: float, min_points: int,
) -> pd.DataFrame:
    """(arrival, event_time_ms, price, change, robust_zscore) of the observations that are not older than the last one.

    Takes the points into ``times`` and ``prices``.  Observations of one
    millisecond differ in their price alone, so each price is judged once.
    """
    top = np.maximum.accumulate(np.concatenate([times[-1:] or t[:1], t]))[:-1]
    arrival, t, p = (x[t >= top] for x in (arrival, t, p))
    found = np.full((len(t), 2), np.nan)
    cuts = [0, *(np.flatnonzero(np.diff(t)) + 1), len(t)] if len(t) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        now = int(t[a])
        if not times or now > times[-1]:
            times.append(now)
            prices.append(math.nan)
        first = max(bisect_left(times, now - window), len(times) - history)
        del times[:first], prices[:first]
        different, which = np.unique(p[a:b], return_inverse=True)
        hits = []
        for price in different:
            prices[-1] = float(price)
            hits.append(anomaly(times, prices, horizon_s, min_return, min_zscore, min_points) or (math.nan, math.nan))
        found[a:b] = np.array(hits)[which]
        prices[-1] = float(p[b - 1])
    return pd.DataFrame({"arrival": arrival, "event_time_ms": t, "price": p, "change": found[:, 0], "robust_zscore": found[:, 1]})


def anomalies(
    tickers: DataFrame,
    horizon_s: int = HORIZON_S,
    min_return: float = MIN_RETURN,
    min_zscore: float = MIN_ZSCORE,
    min_points: int = MIN_POINTS,
    history: int = HISTORY_POINTS,
    delay: str = "10 minutes",
) -> DataFrame:
    """Two evaluations (pump and crash) of each valid observation of (symbol, event_time_ms, price, arrival).

    An observation older than the last is dropped, one of the same millisecond
    takes its place.  ``history`` points of at most 20 horizons (10 minutes at
    least) are kept.  Without an anomaly both evaluations have score 0, which
    clears earlier warnings; prices that are not positive give none.  A key
    without observations for as long as points are kept loses its state, which
    would have been empty by then.
    """
    window = max(horizon_s * 20_000, 600_000)

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple | None, int]:
        times, prices = (list(x) for x in state) if state else ([], [])
        columns = (rows[c].to_numpy() for c in ("arrival", "event_time_ms", "price"))
        out = evaluated(*columns, times, prices, window, history, horizon_s, min_return, min_zscore, min_points)
        return out, (times, prices) if times else None, times[-1] if times else 0

    valid = tickers.where("price > 0").select("symbol", "event_time_ms", "price", "arrival")
    output = "symbol string, arrival long, event_time_ms long, price double, change double, robust_zscore double"
    x = _stateful(valid, ["symbol"], step, output, "times array<long>, prices array<double>", "event_time_ms", delay, window)
    score = F.least(F.lit(100), F.floor(70 + F.least(F.lit(15), F.col("robust_zscore") - min_zscore) + F.least(F.lit(15), F.abs("change") * 500)))
    sides = []
    for up, (family, direction) in zip((True, False), FAMILIES, strict=True):
        on = F.coalesce((F.col("change") > 0) == up, F.lit(False))
        sides.append(F.struct(F.lit(family).alias("family"), F.lit(direction).alias("direction"), F.when(on, score).otherwise(0).cast("long").alias("score"), on.alias("triggered"), F.when(on, F.col("change")).alias("change"), F.when(on, F.col("robust_zscore")).alias("robust_zscore")))
    return x.select("symbol", "arrival", "event_time_ms", "price", F.explode(F.array(*sides)).alias("_x")).select("symbol", "arrival", "event_time_ms", "price", "_x.*")


def bar_admission(bars: DataFrame, keep_ms: int, delay: str) -> DataFrame:
    """(symbol, arrival, open_time_ms, close, status) of each bar of (symbol, open_time_ms, close, is_closed, arrival).

    Status: open (not closed), late (older than the latest closed bar), repeat
    (the latest again, unchanged), corrected (the latest with another close),
    else new.  Only new and corrected bars are admitted.
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple | None, int]:
        latest, close = state or (None, None)
        status = []
        for t, c, closed in zip(rows["open_time_ms"], rows["close"], rows["is_closed"], strict=True):
            if not closed:
                status.append("open")
            elif latest is None or t > latest:
                status.append("new")
            elif t < latest:
                status.append("late")
            else:
                status.append("repeat" if c == close else "corrected")
            if status[-1] in ("new", "corrected"):
                latest, close = int(t), float(c)
        return rows.assign(status=status), None if latest is None else (latest, close), latest or 0

    slim = bars.select("symbol", "open_time_ms", "close", "is_closed", "arrival")
    return _stateful(slim, ["symbol"], step, "symbol string, arrival long, open_time_ms long, close double, status string", "latest long, close double", "open_time_ms", delay, keep_ms)


def latest_quotes(quotes: DataFrame, keep_ms: int, delay: str) -> DataFrame:
    """(symbol, arrival, cursor, bid, ask, status) of each quote of (symbol, cursor, bid, ask, event_time_ms, arrival).

    Status: new (a newer cursor, which becomes the latest), stale (an older
    one), repeat (the latest again) or conflict (the latest cursor with other
    prices; the first one stands).
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple, int]:
        latest = state
        status = []
        for quote in zip(rows["cursor"], rows["bid"], rows["ask"], strict=True):
            if latest is None or quote[0] > latest[0]:
                status.append("new")
                latest = (int(quote[0]), float(quote[1]), float(quote[2]))
            else:
                status.append("stale" if quote[0] < latest[0] else "repeat" if quote[1:] == tuple(latest[1:]) else "conflict")
        return rows.assign(status=status), latest, int(rows["event_time_ms"].max())

    slim = quotes.select("symbol", "cursor", "bid", "ask", "event_time_ms", "arrival")
    return _stateful(slim, ["symbol"], step, "symbol string, arrival long, cursor long, bid double, ask double, status string", "cursor long, bid double, ask double", "event_time_ms", delay, keep_ms)


def gap_hold(live: DataFrame, recovered: DataFrame, step_ms: int, keep_ms: int, delay: str) -> DataFrame:
    """Closed bars of (symbol, open_time_ms, close, arrival) in unbroken order, held back behind gaps.

    A live bar that does not follow the last released one waits until the bars
    between have come, live or from ``recovered``, and is then released right
    after them.  Of a bar that comes twice the first counts; bars up to the last
    released one and recovered bars before the first live one are dropped.
    Returns symbol, place (1 for the key's first bar), open_time_ms, close,
    is_recovered and released_by, the arrival that freed it.  What waits is
    bounded by ``keep_ms``, after which a silent key starts anew.
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple | None, int]:
        place, latest, *held = state or (0, None, [], [], [])
        waiting = {int(t): (c, f) for t, c, f in zip(*held, strict=True)}
        out = []
        for arrival, t, c, again in zip(rows["arrival"], rows["open_time_ms"], rows["close"], rows["is_recovered"], strict=True):
            if latest is None:
                if again:
                    continue
                latest = int(t) - step_ms
            if t <= latest:
                continue
            waiting.setdefault(int(t), (float(c), bool(again)))
            while latest + step_ms in waiting:
                latest += step_ms
                place += 1
                out.append((place, latest, *waiting.pop(latest), arrival))
        frame = pd.DataFrame(out, columns=["place", "open_time_ms", "close", "is_recovered", "released_by"])
        frame = frame.astype({"place": "int64", "open_time_ms": "int64", "close": "float64", "is_recovered": "bool", "released_by": "int64"})
        if latest is None:
            return frame, None, 0
        times = sorted(waiting)
        return frame, (place, latest, times, [waiting[t][0] for t in times], [waiting[t][1] for t in times]), max([latest, *times])

    names = ["symbol", "open_time_ms", "close", "arrival"]
    both = live.select(*names, F.lit(False).alias("is_recovered")).unionByName(recovered.select(*names, F.lit(True).alias("is_recovered")))
    output = "symbol string, place long, open_time_ms long, close double, is_recovered boolean, released_by long"
    return _stateful(both, ["symbol"], step, output, "place long, latest long, times array<long>, closes array<double>, flags array<boolean>", "open_time_ms", delay, keep_ms)
