"""Scalar expressions on columns (returns, labels, buckets, ids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def interval_ms(text: Column) -> Column:
    """``5m`` and the like in milliseconds; null for anything else."""
    unit = F.create_map(*(F.lit(x) for pair in _UNIT_MS.items() for x in pair))[F.regexp_extract(text, "^[0-9]+([mhdw])$", 1)]
    return F.when(text.rlike("^[0-9]+[mhdw]$"), F.regexp_extract(text, "^[0-9]+", 0).cast("long") * unit)


def last_close_before(time_ms: Column, step_ms: int) -> Column:
    """Close time of the last bar that ended strictly before ``time_ms``."""
    return F.floor(time_ms / step_ms) * step_ms - 1


def execution_returns(direction: Column, entry: Column, exit_: Column, fee_bps: float, slippage_bps: float) -> dict[str, Column]:
    """Gross, slippage, fee and net return of a round trip; ``direction`` is 1 or -1."""
    slip, fee = slippage_bps / 10_000, fee_bps / 10_000
    gross = direction * (exit_ - entry) / entry
    paid, got = entry * (1 + direction * slip), exit_ * (1 - direction * slip)
    executed = direction * (got - paid) / entry
    fees = fee * (paid + got) / entry
    return {"gross_return": gross, "slippage_return": F.greatest(F.lit(0.0), gross - executed), "fee_return": fees, "net_return": executed - fees}


def excursion(direction: Column, entry: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Most favourable and most adverse move."""
    up, down = (high - entry) / entry, (low - entry) / entry
    return F.when(direction > 0, up).otherwise(-down), F.when(direction > 0, down).otherwise(-up)


def outcome_label(long_net: Column, short_net: Column, margin: float) -> Column:
    return F.when((long_net > margin) & (long_net > short_net), "LONG").when((short_net > margin) & (short_net > long_net), "SHORT").otherwise("FLAT")


def hit_label(net: Column, margin_bps: float) -> Column:
    margin = margin_bps / 10_000
    return F.when(net > margin, "HIT").when(net < -margin, "MISS").otherwise("AMBIGUOUS")


def micros(value: Column) -> Column:
    """Millionths, ties away from zero."""
    return F.round(value * 1e6).cast("long")


def decision_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def flow_ratio(taker_quote: Column, quote: Column) -> Column:
    """Taker share of quote volume; null without volume."""
    return F.when(quote > 0, taker_quote / quote)


def squash(value: Column, support: Column) -> Column:
    """Strength of a signed value in millionths."""
    return F.floor(F.lit(1e6) * F.abs(value) / (1 + F.abs(value)) * support).cast("long")


def log_loss(label: Column, p: Column) -> Column:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))
