"""Registered queries of opportunities and the trades mapped to them; they join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clean, opportunities
from .market import _OFF_TIES, _register, r, rounded
from .views import DAY_MS, FUNDING, HOUR_MS, funding, ticks

_STEP = 4 * HOUR_MS
_ORIGIN = 1_704_067_200_000
_SPLITS = [opportunities.Split("develop", _ORIGIN - 300 * DAY_MS, _ORIGIN + 16 * DAY_MS), opportunities.Split("hold", _ORIGIN + 17 * DAY_MS, _ORIGIN + 300 * DAY_MS)]
_PLAN = opportunities.Plan(technical=36)
_BARS = f"""{FUNDING}, bars as (select symbol, ts_ms - ts_ms % {_STEP} as open_time_ms, arg_min(price, (ts_ms, agg_id)) as open, arg_max(price, (ts_ms, agg_id)) as close, max(price) as high, min(price) as low from ticks group by 1, 2),
 marks as (select symbol, funding_time_ms, rate, case when (funding_time_ms // {8 * HOUR_MS}) % 3 <> 0 then 300.0::double end as mark_price from funding),
 sg as (select *, open_time_ms + {_STEP - 1} as close_time_ms, case when close > open then 1 else -1 end as direction, cast(sum(case when b then 0 else 1 end) over (partition by symbol order by open_time_ms) as bigint) as seg
  from (select *, coalesce(open_time_ms - lag(open_time_ms) over (partition by symbol order by open_time_ms) = {_STEP}, false) as b from bars))"""
_SPLIT_SQL = ", ".join(f"('{s.name}', {s.start_ms}, {s.end_ms})" for s in _SPLITS)


def _horizon(h: int, embargo: int, extra: int) -> str:
    final = h + extra
    ahead = lambda c, n: f"lead({c}, {n}) over k"
    crosses = f"when {ahead('open_time_ms', final)} >= s.stop then 'technical_exit_open_crosses_split'" if extra else ""
    return f"""select g.*, s.name, {h} as horizon, {ahead('open', 1)} as entry, {ahead('open_time_ms', 1)} as next_open, {ahead('close', h)} as exit, {ahead('close_time_ms', h)} as exit_ms,
 min(low) over (partition by symbol order by open_time_ms rows between 1 following and {_PLAN.technical} following) as lo, max(high) over (partition by symbol order by open_time_ms rows between 1 following and {_PLAN.technical} following) as hi,
 case when {ahead('open_time_ms', final)} is null then 'insufficient_{h}_bar_horizon' when {ahead('seg', final)} <> seg then 'data_gap_in_horizon' when s.start is null then 'outside_declared_split'
 when {ahead('open_time_ms', 1)} < s.start + {embargo * _STEP} then 'split_start_embargo' when {ahead('close_time_ms', h)} >= s.stop then 'horizon_crosses_split' {crosses} end as exclusion
 from ahead g left join splits s on coalesce(g.nxt, g.close_time_ms) >= s.start and coalesce(g.nxt, g.close_time_ms) < s.stop window k as (partition by symbol order by open_time_ms)"""


_SIDE = lambda d: f"({d} * (exit * (1 - {d} * 0.0002::double) - entry * (1 + {d} * 0.0002::double)) / entry - 0.0004::double * (entry * (1 + {d} * 0.0002::double) + exit * (1 - {d} * 0.0002::double)) / entry)"
_OPPORTUNITIES = f"""{_BARS}, splits(name, start, stop) as (values {_SPLIT_SQL}), ahead as (select *, lead(open_time_ms) over (partition by symbol order by open_time_ms) as nxt from sg),
 every as ({' union all '.join(_horizon(h, e, t) for h, e, t in [*((h, _PLAN.embargo, 0) for h in _PLAN.horizons), (_PLAN.technical, _PLAN.technical, 1)])}),
 paid as (select e.symbol, e.open_time_ms, e.horizon, sum(rate * coalesce(mark_price, entry) / entry) as paid from every e join marks m on m.symbol = e.symbol and m.funding_time_ms > e.next_open and m.funding_time_ms < e.exit_ms where exclusion is null group by 1, 2, 3),
 nets as (select e.*, exclusion is null as ok, exclusion is null and e.horizon <> {_PLAN.technical} as near, coalesce(paid, 0) as p, {_SIDE(1)} - coalesce(paid, 0) as long_net, {_SIDE(-1)} + coalesce(paid, 0) as short_net
  from every e left join paid using (symbol, open_time_ms, horizon)),
 opp as (select *, substr(sha256(concat_ws('|', 'futures', symbol, 'bar', close_time_ms::varchar)), 1, 24) as opportunity_id, coalesce(name, 'outside') as split from nets)"""
_MARGIN = f"{_PLAN.margin_bps / 10_000}::double"


def _opportunities(spark, d):
    bars = clean.trade_bars(ticks(spark, d), _STEP).select("symbol", "open_time_ms", "open", "high", "low", "close")
    bars = bars.withColumns({"close_time_ms": F.col("open_time_ms") + (_STEP - 1), "direction": F.when(F.col("close") > F.col("open"), 1).otherwise(-1)})
    marks = funding(spark, d).withColumn("mark_price", F.when(F.floor(F.col("funding_time_ms") / (8 * HOUR_MS)) % 3 != 0, F.lit(300.0)))
    x = opportunities.opportunities(bars, _SPLITS, _STEP, _PLAN, marks)
    return x.withColumn("opportunity_id", scalars.decision_id(F.lit("futures"), F.col("symbol"), F.lit("bar"), F.col("close_time_ms").cast("string")))


# sums of rates end in few digits, so they are moved off the ties of rounding
_IF = lambda c, v: f"{r(f'case when {c} then {v} end + {_OFF_TIES}::double')}"


@_register("j12_opportunities", f"""with {_OPPORTUNITIES} select opportunity_id, symbol, open_time_ms, horizon, direction, split, ok as eligible, exclusion, {_IF('ok', 'direction * (exit - entry) / entry')} as forward_return, {_IF('near', 'long_net')} as long_net, {_IF('near', 'short_net')} as short_net,
 case when near then case when long_net > {_MARGIN} and long_net > short_net then 'LONG' when short_net > {_MARGIN} and short_net > long_net then 'SHORT' else 'FLAT' end end as label, {_IF('near', '-direction * p')} as funding_return,
 {_IF('near', 'case when direction > 0 then long_net else short_net end')} as net_return, {_IF(f'ok and horizon = {_PLAN.technical}', 'case when direction > 0 then (hi - entry) / entry else -(lo - entry) / entry end')} as mfe,
 {_IF(f'ok and horizon = {_PLAN.technical}', 'case when direction > 0 then (lo - entry) / entry else -(hi - entry) / entry end')} as mae from opp""")
def j12(spark, d):
    names = ["opportunity_id", "symbol", "open_time_ms", "horizon", "direction", "split", "eligible", "exclusion", "forward_return", "long_net", "short_net", "label", "funding_return", "net_return", "mfe", "mae"]
    x = _opportunities(spark, d).select(*names)
    return rounded(x.withColumns({c: F.col(c) + _OFF_TIES for c, t in x.dtypes if t == "double"}))


# Trades of the opportunities of 12 bars, a third of them without an id, with planted faults; some come twice.
_K = f"(open_time_ms // {_STEP})"


@_register("j15_mapped_trades", f"""with {_OPPORTUNITIES}, known as (select *, {_K} as k from opp where horizon = 12), copies as (select *, unnest(case when k % 19 = 0 then [0, 1] else [0] end) as copy from known where ok or k % 5 = 0),
 trades as (select opportunity_id || '-' || copy as trade_id, case when k % 3 = 0 then '' when k % 11 = 0 then 'gone' else opportunity_id end as asked, symbol, case when k % 13 = 0 then -direction else direction end as direction, close_time_ms,
  next_open + case when k % 17 = 0 then 1 else 0 end as entry_ms, k % 23 <> 0 as contained from copies),
 m as (select t.*, o.opportunity_id as mapped_id, o.ok, o.next_open, o.direction as own from trades t left join known o on case when t.asked = '' then o.symbol = t.symbol and o.direction = t.direction and o.close_time_ms = t.close_time_ms else o.opportunity_id = t.asked end),
 f as (select *, case when not contained then 'split_crossing' when mapped_id is null and asked <> '' then 'unknown_opportunity' when mapped_id is null then 'not_exactly_one' when own <> direction then 'identity_mismatch' when not ok then 'ineligible'
  when entry_ms is distinct from next_open then 'wrong_entry' end as fault from m)
 select trade_id, mapped_id, coalesce(fault, case when trade_id <> min(trade_id) filter (fault is null) over (partition by mapped_id) then 'repeated' end) as fault from f""")
def j15(spark, d):
    known = _opportunities(spark, d).where("horizon = 12").withColumn("k", F.floor(F.col("open_time_ms") / _STEP))
    k = F.col("k")
    copies = known.where(F.col("eligible") | (k % 5 == 0)).withColumn("copy", F.explode(F.when(k % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    trades = copies.select(
        F.concat("opportunity_id", F.lit("-"), "copy").alias("trade_id"), F.when(k % 3 == 0, "").when(k % 11 == 0, "gone").otherwise(F.col("opportunity_id")).alias("opportunity_id"), "symbol",
        F.when(k % 13 == 0, -F.col("direction")).otherwise(F.col("direction")).alias("direction"), "close_time_ms", (F.col("next_open_time_ms") + (k % 17 == 0).cast("int")).alias("entry_time_ms"), (k % 23 != 0).alias("split_contained"),
    )
    x = opportunities.map_trades(trades, known.select("opportunity_id", "symbol", "direction", "close_time_ms", "eligible", "next_open_time_ms"), ["symbol", "direction", "close_time_ms"])
    return x.select("trade_id", "mapped_id", "fault")
