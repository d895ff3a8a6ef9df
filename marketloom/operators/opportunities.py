"""Opportunities with their outcomes by horizon, and trades mapped to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..stored import written
from .joins import asof
from .series import key, with_segments

_DAY_MS = 86_400_000


@dataclass(frozen=True)
class Split:
    """A declared range of time, half open."""

    name: str
    start_ms: int
    end_ms: int


@dataclass(frozen=True)
class Plan:
    """Horizons in bars, the longer technical one, embargo in bars at the start of a split, costs and the edge that a label needs."""

    horizons: tuple[int, ...] = (3, 6, 12)
    technical: int = 72
    embargo: int = 12
    fee_bps: float = 4.0
    slippage_bps: float = 2.0
    margin_bps: float = 5.0


def _of_split(splits: list[Split], time: Column, value) -> Column:
    out = F.lit(None)
    for s in reversed(splits):
        out = F.when((time >= s.start_ms) & (time < s.end_ms), F.lit(value(s))).otherwise(out)
    return out


def _exclusion(splits: list[Split], step_ms: int, horizon: int, embargo: int, then_open: bool) -> Column:
    """Why the path of ``horizon`` bars (and the open after it) may not count, the first reason that applies; null if it may."""
    w = key()
    ahead = lambda c, n: F.lead(c, n).over(w)
    final, opened = horizon + int(then_open), ahead("open_time_ms", 1)
    start, end = (_of_split(splits, opened, v).cast("long") for v in (lambda s: s.start_ms, lambda s: s.end_ms))
    out = F.when(ahead("open_time_ms", final).isNull(), f"insufficient_{horizon}_bar_horizon").when(ahead("seg", final) != F.col("seg"), "data_gap_in_horizon")
    out = out.when(start.isNull(), "outside_declared_split").when(opened < start + embargo * step_ms, "split_start_embargo").when(ahead("close_time_ms", horizon) >= end, "horizon_crosses_split")
    return out.when(ahead("open_time_ms", final) >= end, "technical_exit_open_crosses_split") if then_open else out


def _with_funding(rows: DataFrame, funding: DataFrame, bucket_ms: int) -> DataFrame:
    """Adds ``_marked`` and ``_plain``: rates times marks, and rates without a mark, strictly between entry and exit.

    Differences of running sums over the payments, which are few beside bars;
    both sums come with one match at the entry and one before the exit.
    """
    mark = F.coalesce(F.col("mark_price"), F.lit(0.0))
    upto = Window.partitionBy("symbol").orderBy("funding_time_ms").rangeBetween(Window.unboundedPreceding, 0)
    sums = {"_m": F.sum(F.col("rate") * mark).over(upto), "_p": F.sum(F.when(mark == 0, F.col("rate")).otherwise(0.0)).over(upto)}
    running = funding.select("symbol", F.col("funding_time_ms").alias("_paid_ms"), *(v.alias(n) for n, v in sums.items()))
    x = asof(rows, running, ["symbol"], "next_open_time_ms", "_paid_ms", strict=False, bucket_ms=bucket_ms).withColumnRenamed("matched", "_from")
    x = asof(x, running, ["symbol"], "exit_ms", "_paid_ms", bucket_ms=bucket_ms)
    part = lambda c: F.coalesce(F.col(f"matched.{c}"), F.lit(0.0)) - F.coalesce(F.col(f"_from.{c}"), F.lit(0.0))
    return x.withColumns({"_marked": part("_m"), "_plain": part("_p")}).drop("matched", "_from")


def opportunities(bars: DataFrame, splits: list[Split], step_ms: int, plan: Plan = Plan(), funding: DataFrame | None = None, bucket_ms: int = _DAY_MS) -> DataFrame:
    """A row for each bar with a ``direction`` (1 or -1) and horizon: eligibility, returns of both sides and of the signal, label, excursion.

    Bars: symbol, open_time_ms, close_time_ms, open, high, low, close, direction;
    all other columns are kept.  Entry is the next open, exit the close after
    ``horizon`` bars.  The technical horizon has the forward return and the
    excursion only, and needs the open after it inside the split as well.
    ``funding`` (symbol, funding_time_ms, rate, mark_price) adds what is paid
    strictly between entry and exit; without a mark the entry price counts.
    One sort of the bars by symbol; the rows of a bar's horizons come from one row.
    Not eligible rows keep ``exclusion`` and have nulls.
    """
    w = key()
    ahead = lambda c, n: F.lead(c, n).over(w)
    asked = [(h, plan.embargo, False) for h in plan.horizons] + [(plan.technical, plan.technical, True)]
    x = with_segments(bars, step_ms).withColumns({"entry": ahead("open", 1), "next_open_time_ms": ahead("open_time_ms", 1)})
    path = w.rowsBetween(1, plan.technical)
    x = x.withColumns({"_low": F.min("low").over(path), "_high": F.max("high").over(path)})
    rows = [
        F.struct(F.lit(h).alias("horizon"), _exclusion(splits, step_ms, h, e, t).alias("exclusion"), ahead("close", h).alias("exit"), ahead("close_time_ms", h).alias("exit_ms"))
        for h, e, t in asked
    ]
    x = x.withColumn("_h", F.array(*rows)).where("direction is not null").select("*", F.inline("_h")).drop("_h", "seg")
    split = F.coalesce(_of_split(splits, F.coalesce("next_open_time_ms", "close_time_ms"), lambda s: s.name), F.lit("outside"))
    x = x.withColumns({"split": split, "eligible": F.col("exclusion").isNull()})
    if funding is None:
        counted = x.where("eligible").withColumns({"_marked": F.lit(0.0), "_plain": F.lit(0.0)})
    else:
        x = written(x)  # read by both branches and by each join of funding
        counted = _with_funding(x.where("eligible"), funding, bucket_ms)
    entry, out, d = F.col("entry"), F.col("exit"), F.col("direction")
    paid = F.col("_marked") / entry + F.col("_plain")
    returns = lambda side: scalars.execution_returns(side, entry, out, plan.fee_bps, plan.slippage_bps)
    signal, technical = returns(d), F.col("horizon") == plan.technical
    best, worst = scalars.excursion(d, entry, F.col("_low"), F.col("_high"))
    near = lambda c: F.when(~technical, c)
    counted = counted.withColumns({"long_net": near(returns(F.lit(1))["net_return"] - paid), "short_net": near(returns(F.lit(-1))["net_return"] + paid)})
    counted = counted.withColumns(
        {
            "forward_return": signal["gross_return"], "label": near(scalars.outcome_label(F.col("long_net"), F.col("short_net"), plan.margin_bps / 10_000)),
            "fee_return": near(signal["fee_return"]), "slippage_return": near(signal["slippage_return"]), "funding_return": near(-d * paid),
            "net_return": near(signal["net_return"] - d * paid), "mfe": F.when(technical, best), "mae": F.when(technical, worst),
        }
    )
    rest = x.where("not eligible").withColumns({"entry": F.lit(None).cast("double"), "exit": F.lit(None).cast("double")})
    return counted.unionByName(rest, allowMissingColumns=True).drop("_low", "_high", "_marked", "_plain")


def map_trades(trades: DataFrame, known: DataFrame, identity: list[str]) -> DataFrame:
    """``trades`` with ``mapped_id`` and ``fault``: the opportunity of each by id or, without one, by ``identity``.

    ``trades``: trade_id, opportunity_id (may be null or empty), ``identity``,
    entry_time_ms, split_contained.  ``known``: opportunity_id, ``identity``,
    eligible, next_open_time_ms, one row an id.  Faults, the first that applies:
    split_crossing, unknown_opportunity, not_exactly_one, identity_mismatch,
    ineligible, wrong_entry, repeated (every trade of an opportunity but that of
    the smallest id); null if the trade counts.  Nulls in ``identity`` match nothing.
    """
    facts = F.struct("opportunity_id", *identity, "eligible", "next_open_time_ms")
    by_id = known.select(F.col("opportunity_id").alias("_key"), facts.alias("_own"))
    alike = known.groupBy(*identity).agg(F.count("*").alias("_n"), F.min(facts).alias("_like"))
    asked = F.when(F.col("opportunity_id") != "", F.col("opportunity_id"))
    x = trades.withColumn("_key", asked).join(by_id, "_key", "left").join(alike, identity, "left")
    named = F.col("_key").isNotNull()
    m = F.when(named, F.col("_own")).when(F.col("_n") == 1, F.col("_like"))
    x = x.withColumn("_m", m)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"_m.{c}").eqNullSafe(F.col(c))
    fault = F.when(~F.coalesce("split_contained", F.lit(False)), "split_crossing").when(named & F.col("_m").isNull(), "unknown_opportunity").when(F.col("_m").isNull(), "not_exactly_one")
    fault = fault.when(~same, "identity_mismatch").when(~F.coalesce("_m.eligible", F.lit(False)), "ineligible").when(~F.col("entry_time_ms").eqNullSafe(F.col("_m.next_open_time_ms")), "wrong_entry")
    x = x.select(*trades.columns, F.col("_m.opportunity_id").alias("mapped_id"), fault.alias("_fault"))
    firsts = x.where("_fault is null").groupBy("mapped_id").agg(F.min("trade_id").alias("_first"))
    x = x.join(firsts, "mapped_id", "left")
    return x.select(*trades.columns, "mapped_id", F.coalesce("_fault", F.when(F.col("trade_id") != F.col("_first"), "repeated")).alias("fault"))
