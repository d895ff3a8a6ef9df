"""Observations with two clocks, and book states clipped to the windows of a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import sorted_window

BAR_MS = 300_000
#: Windows of a bar: name, and its start and length in milliseconds; a negative start counts from the end.
BOOK_WINDOWS = {"first_5s": (0, 5_000), "last_5s": (-5_000, 5_000), "first_30s": (0, 30_000), "last_30s": (-30_000, 30_000), "full": (0, None)}


def two_clock_latest(decisions: DataFrame, rows: DataFrame, keys: list[str], cutoff: str, receipt_cutoff: str, event: str, receipt: str, seq: str, values: list[str], max_age_ms: int) -> DataFrame:
    """Each decision with the newest observation that it could know: event time in [cutoff - max_age_ms, cutoff] and receipt up to its own bound.

    Newest is the largest (event, receipt, seq).  Adds the observation's event,
    receipt, seq and ``values``, n_candidates, and n_conflicts: identities
    (event, receipt, seq) among the candidates that come with several values.
    Without a candidate these are null and the counts 0.  Both sides meet in
    event-time buckets of the greatest age, so a busy key is as many tasks as
    it has buckets, and a decision looks into two.
    """
    names = [event, receipt, seq, *values]
    slim = decisions.select(*keys, F.col(cutoff).alias("_c"), F.col(receipt_cutoff).alias("_r")).distinct()
    bucket = lambda c: F.floor(c / max_age_ms)
    asked = slim.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_c") - max_age_ms), bucket(F.col("_c")))))
    held = rows.select(*keys, F.struct(*names).alias("_x"), bucket(F.col(event)).alias("_bucket"))
    x = asked.join(held, [*keys, "_bucket"])
    x = x.where(F.col(f"_x.{event}").between(F.col("_c") - max_age_ms, F.col("_c")) & (F.col(f"_x.{receipt}") <= F.col("_r")))
    identity = x.groupBy(*keys, "_c", "_r", F.struct(*(f"_x.{c}" for c in (event, receipt, seq))).alias("_k")).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    best = identity.groupBy(*keys, "_c", "_r").agg(F.max("_lo").alias("_best"), F.sum("_n").alias("n_candidates"), F.count_if(F.col("_lo") != F.col("_hi")).alias("n_conflicts"))
    best = best.withColumnsRenamed({"_c": cutoff, "_r": receipt_cutoff})
    out = decisions.join(best, [*keys, cutoff, receipt_cutoff], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_conflicts")]
    return out.select(*decisions.columns, *(F.col(f"_best.{c}").alias(c) for c in names), *counts)


def state_intervals(states: DataFrame, keys: list[str], time: str, seq: str, values: list[str], max_age_ms: int, span_ms: int = 86_400_000) -> DataFrame:
    """(keys, start_ms, end_ms, values): how long each state stood, at most ``max_age_ms``; of one time the largest ``seq`` counts.

    The next state is looked up inside spans of time, and across spans among the
    first states of each, so no task sorts a whole key.  The last state of all
    stands for ``max_age_ms``.
    """
    x = states.groupBy(*keys, F.col(time).alias("start_ms")).agg(F.max(F.struct(seq, *values)).alias("_v"))
    x = x.withColumn("_span", F.floor(F.col("start_ms") / span_ms))
    firsts = x.groupBy(*keys, "_span").agg(F.min("start_ms").alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_span"))).drop("_first")
    x = x.withColumn("_next", F.lead("start_ms").over(Window.partitionBy(*keys, "_span").orderBy("start_ms"))).join(after, [*keys, "_span"])
    stood = F.col("start_ms") + max_age_ms
    return x.select(*keys, "start_ms", F.least(F.coalesce("_next", "_after", stood), stood).alias("end_ms"), *(F.col(f"_v.{c}").alias(c) for c in values))


def book_windows(states: DataFrame, keys: list[str], time: str, seq: str, values: list[str], bar_ms: int = BAR_MS, windows: dict[str, tuple[int, int | None]] | None = None, max_age_ms: int = BAR_MS) -> DataFrame:
    """(keys, open_ms, window, expected_ms, duration_ms, values): states split at the edges of bars and clipped to the windows of each bar.

    Pieces of no length are left out.  A window is covered when its durations
    add up to ``expected_ms``; a state older than ``max_age_ms`` covers nothing.
    """
    windows = BOOK_WINDOWS if windows is None else windows
    x = state_intervals(states, keys, time, seq, values, max_age_ms)
    edge = lambda c: F.floor(c / bar_ms)
    x = x.withColumn("_bar", F.explode(F.sequence(edge(F.col("start_ms")), edge(F.col("end_ms") - 1)))).withColumn("open_ms", (F.col("_bar") * bar_ms).cast("long"))
    parts = []
    for name, (at, length) in windows.items():
        low = F.col("open_ms") + (at if at >= 0 else bar_ms + at)
        whole = length or bar_ms
        duration = F.least("end_ms", low + whole) - F.greatest("start_ms", low)
        parts.append(F.struct(F.lit(name).alias("window"), F.lit(whole).cast("long").alias("expected_ms"), duration.cast("long").alias("duration_ms")))
    return x.select(*keys, "open_ms", F.inline(F.array(*parts)), *values).where("duration_ms > 0")


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, q: float | Column) -> DataFrame:
    """(by, quantile): the smallest value at or below which ``q`` of the weight lies; ``q`` may differ by group."""
    each = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"), F.max(q if isinstance(q, Column) else F.lit(q)).alias("_q"))
    group = Window.partitionBy(*by)
    each = each.withColumns({"_upto": F.sum("_w").over(group.orderBy(value)), "_all": F.sum("_w").over(group)})
    return each.where(F.col("_upto") >= F.col("_all") * F.col("_q")).groupBy(*by).agg(F.min(value).alias("quantile"))


def robust_z(rows: DataFrame, column: str, n: int, order: str = "open_ms") -> DataFrame:
    """Adds ``<column>_rz`` against exactly ``n`` prior rows of the symbol: distance from their median in 1.4826 MAD; null without them or without spread."""
    x = sorted_window(rows, ["symbol"], [order], column, n)
    z = F.when(F.col("prior_mad") > 0, (F.col(column) - F.col("prior_median")) / (1.4826 * F.col("prior_mad")))
    return x.withColumn(f"{column}_rz", z).drop("prior_median", "prior_mad", "prior_ecdf")


def liquidity_bars(trades: DataFrame, states: DataFrame, prior: int = 8640, bar_ms: int = BAR_MS, max_age_ms: int = BAR_MS) -> DataFrame:
    """Flow and book features of each bar whose windows the book covers whole.

    ``trades``: symbol, ts_ms, price, qty, is_buyer_maker.  ``states``: symbol,
    ts_ms, seq, mid, spread_bps, bid_depth and ask_depth.  Returns symbol,
    open_ms, n_trades, signed_notional, notional, flow_imbalance, bar_return
    (log of the median mid of the last five seconds over that of the first),
    d_start, d_low and d_end (median of the first 30 s, 5th percentile of the
    bar, median of the last 30 s of the depth that faces the flow), spread95,
    and the robust z-scores of flow and return against ``prior`` earlier bars.
    A bar without trades has no flow; its facing depth is 0.
    """
    money = F.col("price") * F.col("qty")
    flow = trades.groupBy("symbol", F.expr(f"ts_ms - pmod(ts_ms, {bar_ms}L)").alias("open_ms")).agg(
        F.count("*").alias("n_trades"), F.sum(F.when(F.col("is_buyer_maker"), -money).otherwise(money)).alias("signed_notional"), F.sum(money).alias("notional")
    )
    pieces = book_windows(states, ["symbol"], "ts_ms", "seq", ["mid", "spread_bps", "bid_depth", "ask_depth"], bar_ms, None, max_age_ms)
    pieces = pieces.join(flow.select("symbol", "open_ms", F.signum("signed_notional").alias("sign")), ["symbol", "open_ms"], "left")
    facing = F.when(F.col("sign") > 0, F.col("ask_depth")).when(F.col("sign") < 0, F.col("bid_depth")).otherwise(F.lit(0.0))
    asks = [("first_5s", "mid", 0.5), ("last_5s", "mid", 0.5), ("first_30s", "facing", 0.5), ("full", "facing", 0.05), ("last_30s", "facing", 0.5), ("full", "spread_bps", 0.95)]
    names = ["first_mid", "last_mid", "d_start", "d_low", "d_end", "spread95"]
    asked = [F.when(F.col("window") == w, F.struct(F.lit(n).alias("feature"), F.col(v).alias("value"), F.lit(q).alias("q"))) for n, (w, v, q) in zip(names, asks, strict=True)]
    # every quantile is a group of one aggregate instead of an aggregate of its own
    long = pieces.withColumn("facing", facing).select("symbol", "open_ms", "duration_ms", F.inline(F.array_compact(F.array(*asked))))
    found = weighted_quantile(long, ["symbol", "open_ms", "feature"], "value", "duration_ms", F.col("q"))
    wide = found.groupBy("symbol", "open_ms").agg(*(F.max(F.when(F.col("feature") == n, F.col("quantile"))).alias(n) for n in names))
    total = sum(length or bar_ms for _, length in BOOK_WINDOWS.values())
    whole = pieces.groupBy("symbol", "open_ms").agg(F.sum("duration_ms").alias("_ms")).where(F.col("_ms") == total).drop("_ms")
    x = wide.join(whole, ["symbol", "open_ms"]).join(flow, ["symbol", "open_ms"], "left")
    x = x.withColumns({"flow_imbalance": F.col("signed_notional") / F.col("notional"), "bar_return": F.log(F.col("last_mid") / F.col("first_mid"))})
    z = robust_z(x.where("flow_imbalance is not null").select("symbol", "open_ms", "flow_imbalance"), "flow_imbalance", prior).select("symbol", "open_ms", "flow_imbalance_rz")
    y = robust_z(x.select("symbol", "open_ms", "bar_return"), "bar_return", prior).select("symbol", "open_ms", "bar_return_rz")
    x = x.join(z, ["symbol", "open_ms"], "left").join(y, ["symbol", "open_ms"], "left")
    return x.select("symbol", "open_ms", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "signed_notional", "notional", "flow_imbalance", "bar_return", "d_start", "d_low", "d_end", "spread95", "flow_imbalance_rz", "bar_return_rz")
