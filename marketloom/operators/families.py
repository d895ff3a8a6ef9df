"""Evidence by family: price momentum, participation, and the scores and panels over all families of a slot.

Bars: symbol, seg (contiguous run), open_time_ms, close, quote_volume and
taker_quote.  Scales are of exactly ``n`` strictly earlier rows of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import squash
from .kernels import COUNT_MS
from .records import sorted_window
from .series import segment

# Families that vote, families of context, readiness from worst to best, and the bands of the score.
DIRECTIONAL = ("PRICE_STRUCTURE_MOMENTUM", "PARTICIPATION_FLOW", "CROSS_SECTIONAL_CONTEXT")
CONTEXT = ("VOLATILITY_REGIME", "DERIVATIVES_POSITIONING", "LIQUIDITY_EXECUTION")
UNREADY = ("DATA_INVALID", "INCONCLUSIVE_DATA", "FEATURE_NOT_READY")
MAD_SCALE = 1.4826
LEAN, STRONG = 2_000_000, 4_000_000


def _scaled(rows: DataFrame, column: str, n: int, center: str, mad: str) -> DataFrame:
    """Adds median and MAD of the prior ``n`` values under the given names."""
    x = sorted_window(rows, ["symbol", "seg"], ["open_time_ms"], column, n, chunk_rows=max(50_000, n), bucket=COUNT_MS)
    return x.withColumnsRenamed({"prior_median": center, "prior_mad": mad}).drop("prior_ecdf")


def price_momentum(bars: DataFrame, n: int = 8640, slow: int = 12) -> DataFrame:
    """Bars with ``composite``, ``direction``, ``strength_micros`` and ``status`` of their log returns over 1 and ``slow`` bars.

    Each return over its own 1.4826 MAD, then their mean.  Status:
    FEATURE_NOT_READY_WARMUP before both have ``n`` earlier values,
    FEATURE_NOT_READY_ZERO_SCALE where a MAD is zero, else READY.  Bars without
    a positive close break nothing but have no return, so callers start a new
    run there.
    """
    back = lambda k: F.log(F.col("close") / F.lag("close", k).over(segment()))
    returns = bars.withColumns({"_r1": back(1), "_rs": back(slow)})
    known = returns.where("_r1 is not null and _rs is not null")
    x = _scaled(_scaled(known, "_r1", n, "_m1", "_a1"), "_rs", n, "_ms", "_as")
    early = returns.where("_r1 is null or _rs is null")
    x = x.unionByName(early, allowMissingColumns=True)
    warm = F.col("_a1").isNull() | F.col("_as").isNull()
    status = F.when(warm, "FEATURE_NOT_READY_WARMUP").when((F.col("_a1") <= 0) | (F.col("_as") <= 0), "FEATURE_NOT_READY_ZERO_SCALE").otherwise("READY")
    both = (F.col("_r1") / (MAD_SCALE * F.col("_a1")) + F.col("_rs") / (MAD_SCALE * F.col("_as"))) / 2
    x = x.withColumn("status", status).withColumn("composite", F.when(F.col("status") == "READY", both))
    strength = squash(F.col("composite"), F.lit(1.0))
    direction = F.when(strength > 0, F.signum("composite").cast("int")).when(strength == 0, 0)
    return x.select(*bars.columns, "composite", direction.alias("direction"), strength.alias("strength_micros"), "status")


def flow_proxy(bars: DataFrame, step_ms: int) -> DataFrame:
    """Bars as flow: all trades count as normal, ``signed_notional``, ``total_notional``, ``signed_share`` (null without volume), and ``missing_after``.

    ``missing_after`` is how many slots the symbol lacks before its next bar.
    """
    ahead = F.lead("open_time_ms").over(Window.partitionBy("symbol").orderBy("open_time_ms"))
    signed = 2 * F.col("taker_quote") - F.col("quote_volume")
    return bars.withColumns(
        {
            "signed_notional": signed, "total_notional": F.col("quote_volume"), "signed_share": F.when(F.col("quote_volume") > 0, signed / F.col("quote_volume")),
            "missing_after": F.coalesce(F.floor((ahead - F.col("open_time_ms")) / step_ms) - 1, F.lit(0)).cast("long"),
        }
    )


def participation(flow: DataFrame, n: int = 8640) -> DataFrame:
    """Rows of ``flow_proxy`` with ``scaled_share``, ``activity``, ``direction``, ``strength_micros`` and ``status``.

    The signed share over 1.4826 MAD of the prior ones; its strength counts in
    full from the prior median of total notional on.  INCONCLUSIVE_DATA where
    this bar or one of the prior ``n`` (all of them, if fewer) has no share.
    """
    order = segment()
    x = flow.withColumns({"_share": F.coalesce("signed_share", F.lit(0.0)), "_dark": F.sum(F.col("signed_share").isNull().cast("long")).over(order)})
    # a difference of running counts, whatever the length of the window
    x = x.withColumn("_dark", F.col("_dark") - F.coalesce(F.lag("_dark", n + 1).over(order), F.lit(0)))
    x = _scaled(_scaled(x, "_share", n, "_m", "_a"), "total_notional", n, "_usual", "_unused")
    status = F.when(F.col("_dark") > 0, "INCONCLUSIVE_DATA").when(F.col("_a").isNull(), "FEATURE_NOT_READY_WARMUP")
    status = status.when(F.col("_a") <= 0, "FEATURE_NOT_READY_ZERO_SCALE").when(F.col("_usual") <= 0, "DATA_INVALID_ARITHMETIC").otherwise("READY")
    x = x.withColumn("status", status)
    ready = F.col("status") == "READY"
    x = x.withColumns({"scaled_share": F.when(ready, F.col("signed_share") / (MAD_SCALE * F.col("_a"))), "activity": F.when(ready, F.least(F.col("total_notional") / F.col("_usual"), F.lit(1.0)))})
    strength = squash(F.col("scaled_share"), F.col("activity"))
    direction = F.when(strength > 0, F.signum("signed_share").cast("int")).when(strength == 0, 0)
    return x.select(*flow.columns, "scaled_share", "activity", direction.alias("direction"), strength.alias("strength_micros"), "status")


def _nearest(numerator: Column, denominator: int) -> Column:
    """Whole division to the nearest, halves away from zero."""
    return (F.signum(numerator) * F.floor((2 * F.abs(numerator) + denominator) / (2 * denominator))).cast("long")


def registered(observations: DataFrame, slot: list[str], family: str, source: str, content: list[str], families: tuple[str, ...] = DIRECTIONAL + CONTEXT) -> DataFrame:
    """(slot, missing, conflicting, shared, complete): whether a slot has one observation of each family.

    Repeated observations alike in ``content`` are one; others of the same
    family conflict.  ``shared`` counts sources that more than one family owns.
    Unknown families and nulls count as conflicts.
    """
    known = F.coalesce(F.col(family).isin(*families), F.lit(False))
    each = observations.groupBy(*slot, family, source, *content).agg(F.lit(1).alias("_one"))
    owners = each.groupBy(*slot, family, source).agg(F.sum("_one").alias("_rows"))
    # one pass by source and one by family, put together as rows of one table
    by_family = owners.groupBy(*slot, family).agg(F.sum("_rows").alias("_rows"))
    by_family = by_family.select(*slot, (known & (F.col("_rows") >= 1)).cast("long").alias("_have"), F.when(known, F.col("_rows") - 1).otherwise(F.col("_rows")).alias("_conflicts"), F.lit(0).cast("long").alias("_shared"))
    by_source = owners.groupBy(*slot, source).agg((F.count("*") > 1).cast("long").alias("_shared"))
    by_source = by_source.select(*slot, F.lit(0).cast("long").alias("_have"), F.lit(0).cast("long").alias("_conflicts"), "_shared")
    x = by_family.unionByName(by_source).groupBy(*slot).agg((F.lit(len(families)) - F.sum("_have")).alias("missing"), F.sum("_conflicts").alias("conflicting"), F.sum("_shared").alias("shared"))
    return x.withColumn("complete", (F.col("missing") == 0) & (F.col("conflicting") == 0) & (F.col("shared") == 0))


def _votes(rows: DataFrame, slot: list[str], ready: Column, counted: Column) -> DataFrame:
    """By slot: the sum of direction and strength, how many are up and down, and the worst readiness among ``counted``."""
    up, down = counted & (F.col("direction") == 1), counted & (F.col("direction") == -1)
    place = F.min(F.when(counted & ready.isin(*UNREADY), F.array_position(F.array(*(F.lit(s) for s in UNREADY)), ready)))
    return rows.groupBy(*slot).agg(
        F.sum(F.when(counted, F.col("direction") * F.col("strength_micros")).otherwise(0)).alias("_sum"), F.count_if(up).alias("bullish"), F.count_if(down).alias("bearish"),
        place.alias("_place"), F.array_sort(F.collect_list(F.when(~counted & (ready != "READY"), F.col("family")))).alias("context_withheld"),
    )


def evidence_score(observations: DataFrame, slot: list[str]) -> DataFrame:
    """(slot, status, bias, score_micros, bullish, bearish, neutral, reasons) of complete slots: six capped families, no probability.

    Observations: slot, family, direction, strength_micros, readiness, closed,
    causal, close_ms, cutoff_ms, event_ms and receipt_ms.  In this order: an open
    bar, then events before the close or after their receipt and receipts after
    the cut-off make it DATA_INVALID; missing causal inputs INCONCLUSIVE_DATA;
    then the worst readiness of a family.
    """
    faults = {
        "PRECLOSE_EVENT_FORBIDDEN": F.col("event_ms") < F.col("close_ms"), "POSTRECEIPT_EVENT_FORBIDDEN": F.col("event_ms") > F.col("receipt_ms"),
        "LATE_RECEIPT_FORBIDDEN": F.col("receipt_ms") > F.col("cutoff_ms"),
    }
    named = lambda c, name: F.array_sort(F.collect_list(F.when(c, F.concat(F.lit(name + ":"), F.col("family")))))
    ready = F.col("readiness")
    unready = {s: named(ready == s, s) for s in UNREADY}
    up, down = F.count_if(F.col("direction") == 1), F.count_if(F.col("direction") == -1)
    x = observations.groupBy(*slot).agg(
        F.bool_and("closed").alias("_closed"), F.bool_and("causal").alias("_causal"), F.concat(*(named(c, name) for name, c in faults.items())).alias("_faults"),
        *(v.alias(f"_{s}") for s, v in unready.items()), F.sum(F.col("direction") * F.col("strength_micros")).alias("_sum"), up.alias("bullish"), down.alias("bearish"),
    )
    has = lambda c: F.size(c) > 0
    status = F.when(~F.col("_closed") | has("_faults"), "DATA_INVALID").when(~F.col("_causal"), "INCONCLUSIVE_DATA")
    reasons = F.when(~F.col("_closed"), F.array(F.lit("UNCLOSED_CANDLE_FORBIDDEN"))).when(has("_faults"), F.col("_faults"))
    reasons = reasons.when(~F.col("_causal"), F.array(F.lit("CAUSAL_INPUTS_INCOMPLETE")))
    for s in UNREADY:
        status, reasons = status.when(has(f"_{s}"), s), reasons.when(has(f"_{s}"), F.col(f"_{s}"))
    x = x.withColumns({"status": status.otherwise("READY"), "reasons": reasons.otherwise(F.array())})
    total, many, few = F.col("_sum"), F.col("bullish"), F.col("bearish")
    bias = F.when((total >= STRONG) & (many >= 4) & (few <= 1), "BULLISH_STRONG").when((total >= LEAN) & (many >= 3), "BULLISH_LEAN")
    bias = bias.when((total <= -STRONG) & (few >= 4) & (many <= 1), "BEARISH_STRONG").when((total <= -LEAN) & (few >= 3), "BEARISH_LEAN").otherwise("NEUTRAL")
    ok = F.col("status") == "READY"
    six = len(DIRECTIONAL + CONTEXT)
    return x.select(
        *slot, "status", F.when(ok, bias).otherwise("NOT_AVAILABLE").alias("bias"), F.when(ok, _nearest(total, six)).alias("score_micros"),
        *(F.when(ok, c).alias(n) for n, c in (("bullish", many), ("bearish", few), ("neutral", six - many - few))), F.array_join("reasons", ",").alias("reasons"),
    )


def directional_panel(observations: DataFrame, slot: list[str]) -> DataFrame:
    """(slot, status, state, agreement_micros, bullish, bearish, context_withheld): three families vote, context never does.

    An observation of an open bar, with an event after its receipt or a receipt
    after the cut-off is DATA_INVALID, one without causal inputs
    INCONCLUSIVE_DATA, whatever it says itself.
    """
    invalid = ~F.col("closed") | (F.col("event_ms") > F.col("receipt_ms")) | (F.col("receipt_ms") > F.col("cutoff_ms"))
    x = observations.withColumn("_ready", F.when(invalid, "DATA_INVALID").when(~F.col("causal"), "INCONCLUSIVE_DATA").otherwise(F.col("readiness")))
    x = _votes(x, slot, F.col("_ready"), F.col("family").isin(*DIRECTIONAL))
    ok = F.col("_place").isNull()
    up, down = F.col("bullish"), F.col("bearish")
    state = F.when((up == 3) & (down == 0), "BROAD_BULLISH_STATE").when((up >= 2) & (down == 0), "BULLISH_STATE_TILT")
    state = state.when((down == 3) & (up == 0), "BROAD_BEARISH_STATE").when((down >= 2) & (up == 0), "BEARISH_STATE_TILT").otherwise("MIXED_OR_NEUTRAL_STATE")
    status = F.when(ok, "READY").otherwise(F.element_at(F.array(*(F.lit(s) for s in UNREADY)), F.col("_place").cast("int")))
    return x.select(
        *slot, status.alias("status"), F.when(ok, state).otherwise("WITHHELD").alias("state"), F.when(ok, _nearest(F.col("_sum"), len(DIRECTIONAL))).alias("agreement_micros"),
        F.when(ok, up).alias("bullish"), F.when(ok, down).alias("bearish"), F.array_join("context_withheld", ",").alias("context_withheld"),
    )
