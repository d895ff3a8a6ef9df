"""Entry gates and what they do to rules, fee versions of fills, and clock bounds of receipts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof

# Fixed values: (least value, points), highest first.
_ADX_POINTS = ((20, 15), (15, 8))
_ACTIVITY_POINTS = ((1.0, 35), (0.5, 25), (0.0, 10))
_TAKER_POINTS = ((0.10, 35), (0.03, 25), (0.0, 10))
_PRESSURE_POINTS = ((0.05, 30), (0.015, 20), (0.0, 10))
_CROWDING_RISK = ((3.0, 95), (2.0, 75), (1.0, 50), (0.5, 25))


@dataclass(frozen=True)
class GateLimits:
    """Least scores of the gates, the crowding risk that fails, and the widest spread."""

    trend: int = 60
    participation: int = 60
    crowding: int = 75
    execution: int = 65
    completeness: int = 95
    spread_bps: float = 15.0


def steps(value: Column, points: tuple[tuple[float, int], ...], below: int = 0) -> Column:
    """Points of the first step that ``value`` reaches; below all steps, or null, ``below``."""
    found = F.lit(below)
    for least, score in reversed(points):
        found = F.when(value >= least, score).otherwise(found)
    return found


def trend_score(direction: Column, contexts: tuple[str, ...] = ()) -> Column:
    """Slope, averages and strength along ``direction``; each context adds 15 if its averages and price agree.

    A context is a struct column with ema20, ema50 and price, null where none is
    available.  Without contexts the score is spread over the whole range.
    """
    d, c = direction, F.col
    # equal averages count as those of a falling market
    up = F.when(c("ema20") > c("ema50"), 1).otherwise(-1)
    own = F.when(d * c("ema20_slope_atr") > 0, 30).otherwise(0) + F.when(up == d, 25).otherwise(0) + steps(c("adx"), _ADX_POINTS)
    if not contexts:
        return F.least(F.lit(100), F.round(own / 0.7).cast("int"))
    for x in contexts:
        agrees = (d * (c(f"{x}.ema20") - c(f"{x}.ema50")) > 0) & (d * (c(f"{x}.price") - c(f"{x}.ema20")) > 0)
        own = own + F.when(agrees, 15).otherwise(0)
    return F.least(F.lit(100), own)


def entry_gates(rows: DataFrame, limits: GateLimits = GateLimits(), contexts: tuple[str, ...] = (), futures: Column | None = None) -> DataFrame:
    """Adds the five gate scores, ``failures`` (names in a fixed order) and ``passed``; one gate never makes up for another.

    ``rows`` has direction (1 or -1), ema20, ema50, adx, ema20_slope_atr,
    volume_zscore, trade_count_zscore, taker_imbalance, cvd_pressure,
    funding_zscore, spread_bps, spread_is_proxy and completeness.  A null
    taker_imbalance fails for want of flow, a null funding_zscore fails where
    ``futures`` holds, a null or too wide spread has no execution score.
    """
    c, d = F.col, F.col("direction")
    flow = c("taker_imbalance").isNotNull()
    participation = steps(F.greatest("volume_zscore", "trade_count_zscore"), _ACTIVITY_POINTS) + steps(d * c("taker_imbalance"), _TAKER_POINTS) + steps(d * c("cvd_pressure"), _PRESSURE_POINTS)
    unfunded = c("funding_zscore").isNull() & (F.lit(False) if futures is None else futures)
    risk = F.when(unfunded, 100).when(c("funding_zscore").isNull(), 0).otherwise(steps(d * c("funding_zscore"), _CROWDING_RISK, 10))
    narrow = F.coalesce(c("spread_bps") <= limits.spread_bps, F.lit(False))
    execution = F.when(~narrow, 0).when(c("spread_is_proxy"), 65).when(c("spread_bps") <= limits.spread_bps / 2, 100).otherwise(75)
    scored = rows.withColumns(
        {
            "trend_score": trend_score(d, contexts),
            "participation_score": F.when(flow, participation).otherwise(0),
            "crowding_risk": risk,
            "execution_score": execution,
            "completeness_score": F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c("completeness") * 100).cast("int"))),
        }
    )
    named = [(f"no {x} context", c(x).isNull()) for x in contexts]
    named += [
        ("trend", c("trend_score") < limits.trend),
        ("participation", participation < limits.participation),
        ("no flow", ~flow),
        ("no funding", unfunded),
        ("crowding", c("crowding_risk") >= limits.crowding),
        ("execution", c("execution_score") < limits.execution),
        ("spread", ~narrow),
        ("completeness", c("completeness_score") < limits.completeness),
    ]
    failures = F.array_compact(F.array(*(F.when(failed, name) for name, failed in named)))
    return scored.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def apply_gates(rules: DataFrame, confirmed_score: int | None = None, keep_failed: bool = True) -> DataFrame:
    """``score`` and ``eligible`` after the gates, with the score before as ``raw_score``.

    A rule without a score stays without one.  Failed rules keep their score
    only if ``keep_failed`` or informational; passed ones are lifted to
    ``confirmed_score`` where one is given.  Informational rules never pass.
    """
    informational = F.col("informational") if "informational" in rules.columns else F.lit(False)
    eligible = F.col("passed") & ~informational
    score, raw = F.col("score"), F.col("raw_score")
    lifted = raw if confirmed_score is None else F.greatest(raw, F.lit(confirmed_score))
    failed = raw if keep_failed else F.when(informational, raw).otherwise(0)
    return rules.withColumn("raw_score", score).withColumns({"score": F.when(raw == 0, raw).when(eligible, lifted).otherwise(failed), "eligible": eligible})


def action_label(market: Column, family: Column, direction: Column, informational: Column | None = None) -> Column:
    """What a decision asks for; ``market`` is spot or futures, ``direction`` 1 or -1."""
    long, spot = direction > 0, market == "spot"
    out = F.when(informational if informational is not None else F.lit(False), "INFORMATION_ONLY")
    out = out.when(family == "pump_risk", "PUMP_RISK").when(family == "crash_risk", "CRASH_RISK")
    leaves = family == "technical_exit"
    out = out.when(spot & (leaves | ~long), "SPOT_EXIT").when(spot, "SPOT_BUY")
    return out.otherwise(F.concat(F.lit("FUTURES_"), F.when(long, "LONG").otherwise("SHORT"), F.when(leaves, "_EXIT").otherwise("")))


def fee_versions(fills: DataFrame, captures: DataFrame, keys: list[str], fill_time: str, capture_time: str, rate: str, bucket_ms: int | None = None) -> DataFrame:
    """``fills`` with ``fee_rate`` and ``fee_status`` by the captures around them.

    A rate is known at a capture, and between two captures that agree.  After
    the last capture it is pending, between differing ones inconclusive, before
    the first one unknown.  ``captures`` has one row a key and time; each takes
    its next one's rate along, so fills are sorted once (within ``bucket_ms``).
    """
    following = F.lead("_rate").over(Window.partitionBy(*keys).orderBy("_at"))
    c = captures.select(*keys, F.col(capture_time).cast("long").alias("_at"), F.col(rate).cast("double").alias("_rate"))
    c = c.withColumns({"_next": following, "_open": F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at")).isNull()})
    x = asof(fills, c, keys, fill_time, "_at", strict=False, bucket_ms=bucket_ms)
    m = F.col("matched")
    known = (m["_at"] == F.col(fill_time)) | (m["_rate"] == m["_next"])
    status = F.when(m.isNull(), "NO_CAPTURE_BEFORE").when(known, "RESOLVED").when(m["_open"], "PENDING_OPEN_TAIL").otherwise("INCONCLUSIVE_FEE_VERSION")
    return x.withColumns({"fee_status": status, "fee_rate": F.when(status == "RESOLVED", m["_rate"])}).drop("matched")


def position_fees(slices: DataFrame, keys: list[str], notional: str) -> DataFrame:
    """Fee of each position from its slices; null, with how many slices are open, unless every slice's rate is resolved."""
    unresolved = F.count_if(F.col("fee_status") != "RESOLVED")
    fee = F.sum(F.col(notional) * F.col("fee_rate"))
    return slices.groupBy(*keys).agg(F.count(F.lit(1)).alias("slices"), unresolved.alias("unresolved"), F.when(unresolved == 0, fee).alias("fee"))


def clock_bounds(receipts: DataFrame, receipt_ns: str, cutoff_ms: str, max_age_ns: int, rate_error_ppm: int = 1000, margin_ms: int = 1) -> DataFrame:
    """Adds ``lower_ms`` and ``upper_ms`` of the venue's time at a receipt, and ``verdict`` and ``reason`` against the cut-off.

    ``receipts`` has the latest sample as struct ``matched`` (server_ms,
    request_ns, first_byte_ns, available_ns), or null.  The local clock is
    trusted to ``rate_error_ppm`` since the sample; a sample not yet available or
    older than ``max_age_ns`` gives no bounds.
    """
    m, at = F.col("matched"), F.col(receipt_ns)
    usable = m.isNotNull() & (at >= m["available_ns"]) & (at - m["available_ns"] <= max_age_ns)
    ns = lambda since, ppm: (at - m[since]).cast("decimal(20,0)") * F.lit(1_000_000 + ppm).cast("decimal(8,0)")
    # whole-number division of decimals: longs would overflow after hours
    x = receipts.withColumns({"_slow": ns("first_byte_ns", -rate_error_ppm), "_fast": ns("request_ns", rate_error_ppm) + F.lit(10**12 - 1).cast("decimal(13,0)")})
    unit = "cast(1000000000000 as decimal(13,0))"
    x = x.withColumns(
        {
            "lower_ms": F.when(usable, m["server_ms"] + F.expr(f"_slow div {unit}") - margin_ms),
            "upper_ms": F.when(usable, m["server_ms"] + F.expr(f"_fast div {unit}") + margin_ms),
        }
    )
    cutoff = F.col(cutoff_ms)
    reason = (
        F.when(m.isNull(), "clock_sample_missing").when(at < m["available_ns"], "clock_sample_not_yet_available").when(~usable, "clock_sample_stale")
        .when(F.col("upper_ms") <= cutoff, "receipt_interval_at_or_before_cutoff").when(F.col("lower_ms") > cutoff, "receipt_interval_after_cutoff").otherwise("receipt_interval_straddles_cutoff")
    )
    verdict = F.when(F.col("reason") == "receipt_interval_at_or_before_cutoff", "ADMISSIBLE").when(F.col("reason") == "receipt_interval_after_cutoff", "LATE").otherwise("CLOCK_INCONCLUSIVE")
    return x.drop("_slow", "_fast").withColumn("reason", reason).withColumn("verdict", verdict)


def first_reaching(receipts: DataFrame, keys: list[str], order: list[str], lower: str, step_ms: int) -> DataFrame:
    """For each multiple of ``step_ms`` the first receipt, by ``order``, whose lower bound reaches it, as ``target_ms``.

    Targets begin with the last one that a key's first bounded receipt has
    reached.  A receipt answers the targets between the highest bound before it
    and its own, so no target is joined with receipts.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = receipts.where(F.col(lower).isNotNull()).withColumn("_before", F.max(lower).over(w))
    now = F.floor(F.col(lower) / step_ms)
    since = F.coalesce(F.floor(F.col("_before") / step_ms) + 1, now)
    reached = x.withColumns({"_since": since, "_now": now}).where("_since <= _now")
    return reached.withColumn("_target", F.explode(F.sequence("_since", "_now"))).select(*receipts.columns, (F.col("_target") * step_ms).alias("target_ms"))
