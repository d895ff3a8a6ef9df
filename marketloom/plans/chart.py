"""Registered queries of chart structure, with SQL that joins pivots and bars outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals, structure
from .market import _SEG, _over, _recursive, _register, r, rounded
from .views import DAY_MS

#: Bars with ATR, EMA20 and EMA50, and their pivots with prominence over the ATR at which they become known.
_BARS = f"""{_SEG}, seed as (select *, avg(close) {_over(-19, 0)} as s20, avg(close) {_over(-49, 0)} as s50, avg(true_range) {_over(-13, 0)} as sa from t),
 e as (select symbol, seg, rn, cast(null as double) as ema20, cast(null as double) as ema50, cast(null as double) as atr from seed where rn = 1
  union all select s.symbol, s.seg, s.rn, case when s.rn = 20 then s.s20 when s.rn > 20 then e.ema20 + (s.close - e.ema20) * (2.0::double / 21) end,
   case when s.rn = 50 then s.s50 when s.rn > 50 then e.ema50 + (s.close - e.ema50) * (2.0::double / 51) end,
   case when s.rn = 14 then s.sa when s.rn > 14 then e.atr + (s.true_range - e.atr) * (1.0::double / 14) end from e join seed s on s.symbol = e.symbol and s.seg = e.seg and s.rn = e.rn + 1),
 ebars as (select t.symbol, t.seg, t.rn, open_time_ms, high, low, close, quote_volume, ema20, ema50, atr, coalesce(t.true_range, high - low) as tr from t join e using (symbol, seg, rn)),
 sides as (select *, 2 * side - 3 as side2 from ebars, range(1, 3) s(side)),
 flipped as (select symbol, seg, rn, open_time_ms, side2 as side, case when side2 > 0 then high else -low end as up, case when side2 > 0 then low else -high end as dn from sides),
 around as (select *, max(up) over b as up_b, max(up) over a as up_a, min(dn) over b as dn_b, min(dn) over a as dn_a, count(*) over b as n_b, count(*) over a as n_a from flipped
  window b as (partition by symbol, seg, side order by rn rows between 2 preceding and 1 preceding), a as (partition by symbol, seg, side order by rn rows between 1 following and 2 following)),
 pivots as (select p.symbol, p.seg, p.rn, p.open_time_ms, p.side, p.up as price, greatest(0, up - greatest(dn_b, dn_a)) / k.atr as prominence, k.atr as known_atr from around p join ebars k on k.symbol = p.symbol and k.seg = p.seg and k.rn = p.rn + 2
  where n_b = 2 and n_a = 2 and up > up_b and up >= up_a and k.atr > 0 and greatest(0, up - greatest(dn_b, dn_a)) / k.atr >= 0.75::double)"""


def _bars(spark, d):
    return _recursive(spark, d).select("symbol", "seg", "open_time_ms", "high", "low", "close", "quote_volume", "atr", "ema20", "ema50")


@_register("w22_qualified_pivots", f"with recursive {_BARS} select symbol, open_time_ms, case when side > 0 then 'high' else 'low' end as kind, {r('side * price')} as price, {r('prominence')} as prominence_atr, open_time_ms + {2 * DAY_MS} as known_ms from pivots")
def w22(spark, d):
    # chunks of a few hundred bars, so that their seams are in the test too
    return rounded(structure.qualified_pivots(_bars(spark, d), DAY_MS, 300))


#: Of each bar the pivots known one bar before, newest first, on either side, and what follows from them.
_STATE = f"""{_BARS}, refs as (select *, lag(atr) over w as ref, lag(ema20) over w as ref_e, lag(high) over w as high1, lag(low) over w as low1 from ebars window w as (partition by symbol, seg order by rn)),
 seen as (select b.symbol, b.seg, b.rn, p.side, count(*) as n, list({{'i': p.rn, 'price': p.price * p.side, 'atr': p.known_atr}} order by p.rn desc) as ps from ebars b join pivots p on p.symbol = b.symbol and p.seg = b.seg and p.rn between b.rn - 100 and b.rn - 3 group by 1, 2, 3, 4),
 joined as (select b.*, coalesce(h.n, 0) as n_h, coalesce(l.n, 0) as n_l, h.ps as hs, l.ps as ls, ref > 0 and ref_e is not null as usable from refs b left join seen h on h.symbol = b.symbol and h.seg = b.seg and h.rn = b.rn and h.side = 1
  left join seen l on l.symbol = b.symbol and l.seg = b.seg and l.rn = b.rn and l.side = -1 where b.rn > 1),
 two as (select *, coalesce(usable and n_h >= 2 and n_l >= 2, false) as ok, hs[1].price - hs[2].price as dh, ls[1].price - ls[2].price as dl from joined),
 lined as (select *, dh / (hs[1].i - hs[2].i) as sh, dl / (ls[1].i - ls[2].i) as sl, case when not ok then null when dh > 0.1::double * ref and dl > 0.1::double * ref then 'bullish' when dh < -0.1::double * ref and dl < -0.1::double * ref then 'bearish' else 'mixed' end as state from two),
 state as (select *, hs[1].price + sh * (rn - hs[1].i) as res0, ls[1].price + sl * (rn - ls[1].i) as sup0 from lined)"""


@_register(
    "w23_structure_state",
    f"""with recursive {_STATE} select symbol, open_time_ms, case when usable then n_h end as high_count, case when usable then n_l end as low_count, state, case when ok then {r('dh / ref')} end as high_change_atr, case when ok then {r('dl / ref')} end as low_change_atr,
 case when ok and sup0 > 0 then {r('sup0', 4)} end as support, case when ok and res0 > 0 then {r('res0', 4)} end as resistance, case when ok then {r('sl / ref')} end as support_slope_atr, case when ok then {r('sh / ref')} end as resistance_slope_atr,
 case when ok then sup0 > 0 and close < sup0 end as support_broken, case when ok then res0 > 0 and close > res0 end as resistance_broken from state""",
)
def w23(spark, d):
    x = structure.structure(_bars(spark, d), DAY_MS, 300).withColumns({c: F.round(c, 4) for c in ("support", "resistance")})
    names = ["high_count", "low_count", "state", "high_change_atr", "low_change_atr", "support", "resistance", "support_slope_atr", "resistance_slope_atr", "support_broken", "resistance_broken"]
    return rounded(x.select("symbol", "open_time_ms", *names))


#: Pullbacks from the bars between the pivots, looked up outright.
_PULLS = f"""{_STATE}, legs as (select symbol, seg, rn, open_time_ms, close, ref, case state when 'bullish' then 1 else -1 end as side, case state when 'bullish' then hs[1] else ls[1] end as tip,
  case state when 'bullish' then list_filter(ls, lambda p: p.i < hs[1].i)[1] else list_filter(hs, lambda p: p.i < ls[1].i)[1] end as start, high1, low1 from state where state in ('bullish', 'bearish')),
 whole as (select *, side * (tip.price - start.price) as impulse from legs where start is not null and side * (tip.price - start.price) > 0),
 parts as (select l.symbol, l.seg, l.rn, arg_min(b.rn, (l.side * case when l.side > 0 then b.low else b.high end, b.rn)) filter (b.rn > l.tip.i) as ext_rn,
  median(b.tr) filter (b.rn > l.tip.i) as pull_tr, median(b.tr) filter (b.rn <= l.tip.i) as leg_tr, median(b.quote_volume) filter (b.rn > l.tip.i) as pull_q, median(b.quote_volume) filter (b.rn <= l.tip.i) as leg_q
  from whole l join ebars b on b.symbol = l.symbol and b.seg = l.seg and b.rn between l.start.i and l.rn group by 1, 2, 3),
 extremes as (select w.*, p.*exclude (symbol, seg, rn), case when side > 0 then x.low else x.high end as ext, y.atr as ext_atr, y.ema20 as ext_e from whole w join parts p using (symbol, seg, rn)
  join ebars x on x.symbol = w.symbol and x.seg = w.seg and x.rn = p.ext_rn join ebars y on y.symbol = w.symbol and y.seg = w.seg and y.rn = p.ext_rn - 1),
 measured as (select *, impulse / tip.atr as size_atr, side * (tip.price - ext) / impulse as depth, rn - tip.i as n_bars, case when ext_atr > 0 then abs(ext - ext_e) / ext_atr end as conf,
  case when side > 0 then close > high1 else close < low1 end as recovered, side * close >= side * start.price - 0.25::double * ref as intact from extremes),
 pulls as (select *, case when not intact or depth > 0.75::double then 'invalid' when size_atr >= 2 and depth between 0.2::double and 0.6::double and n_bars <= 12 and coalesce(conf <= 0.25::double, false) and recovered and intact then 'ready'
  when size_atr >= 2 and depth between 0 and 0.75::double and n_bars <= 12 then 'developing' else 'none' end as status from measured)"""


@_register(
    "w24_pullback_metrics",
    f"""with recursive {_PULLS} select symbol, open_time_ms, case when side > 0 then 'long' else 'short' end as pullback_direction, status as pullback_status, {r('start.price')} as impulse_start, {r('tip.price')} as impulse_end, {r('size_atr', 5)} as impulse_size_atr,
 {r('depth')} as pullback_depth, n_bars as pullback_bars, {r('conf', 5)} as confluence_atr, case when leg_tr > 0 then {r('pull_tr / leg_tr', 5)} end as range_ratio, case when leg_q > 0 then {r('pull_q / leg_q', 5)} end as quote_ratio, recovered, intact from pulls""",
)
def w24(spark, d):
    x = structure.structure(_bars(spark, d), DAY_MS, 300).where("pullback_status is not null").withColumns({c: F.round(c, 5) for c in ("impulse_size_atr", "confluence_atr", "range_ratio", "quote_ratio")})
    names = ["pullback_direction", "pullback_status", "impulse_start", "impulse_end", "impulse_size_atr", "pullback_depth", "pullback_bars", "confluence_atr", "range_ratio", "quote_ratio", "recovered", "intact"]
    return rounded(x.select("symbol", "open_time_ms", *names))


@_register(
    "r03_pullback_rules",
    f"""with recursive {_PULLS}, sloped as (select *, (ema20 - lag(ema20, 3) over (partition by symbol, seg order by rn)) / nullif(atr, 0) as slope from ebars),
 asked as (select s.*, d.direction, p.side, p.status, p.start.price as start_price, size_atr, depth, n_bars, conf, recovered, intact from sloped s, (values (1), (-1)) d(direction) left join pulls p on p.symbol = s.symbol and p.seg = s.seg and p.rn = s.rn where s.rn > 1),
 judged as (select *, coalesce(direction * (close - ema50) > 0 and direction * (ema20 - ema50) > 0 and direction * slope > 0, false) as trend, coalesce(side = direction and size_atr >= 2, false) as structural, coalesce(depth between 0.2::double and 0.6::double, false) as deep,
  coalesce(intact and n_bars <= 12, false) as soon, coalesce(conf <= 0.25::double, false) as close_by, coalesce(recovered, false) as back from asked),
 scored as (select *, case when trend then 20 else 0 end + case when structural then 20 else 0 end + case when deep then 20 else 0 end + case when soon then 15 else 0 end + case when close_by then 10 else 0 end + case when back then 15 else 0 end as points,
  coalesce(status = 'ready', false) and trend and structural and deep and soon and close_by and back as ready from judged)
select symbol, open_time_ms, case when direction > 0 then 'pullback_long' else 'pullback_short' end as family, direction, case when not structural then 0 when not ready then least(points, 69) else points end as score, ready as triggered, false as eligible, {r('start_price - direction * 0.25::double * atr', 4)} as invalidation from scored""",
)
def r03(spark, d):
    bars = _bars(spark, d)
    sloped = bars.withColumn("slope", signals.slopes()["ema20_slope_atr"])
    x = structure.pullback_rules(sloped, structure.structure(bars, DAY_MS, 300))
    return rounded(x, 4)
