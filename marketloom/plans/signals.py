"""Registered queries of anatomy, directional features, touches, regimes, bootstraps, books and delivery; they join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import series, signals
from .market import _BREAKS, _LAG, _OSC, _breaks, _over, _recursive, _register, r, rounded
from .views import DAY_MS, HOUR_MS, PRINTS, TICKS, candles, candles_sql, epoch_ms, prints, table, ticks


@_register("f01_bar_anatomy", f"""with {candles_sql()} select symbol, open_time_ms, {r('case when quote_volume > 0 then taker_quote / quote_volume end')} as taker_ratio, {r('quote_volume - taker_quote', 2)} as sell_quote,
 {r('greatest(0, (high - greatest(open, close)) / greatest(high - low, 1e-12::double))')} as upper_wick, {r('greatest(0, (least(open, close) - low) / greatest(high - low, 1e-12::double))')} as lower_wick, open_time_ms % {DAY_MS} = 0 as aligned, close_time_ms as close_ms, close_time_ms + 2001 as cutoff_ms from candles""")
def f01(spark, d):
    x = candles(spark, d).withColumns({"taker_ratio": scalars.flow_ratio(F.col("taker_quote"), F.col("quote_volume")), "sell_quote": F.round(F.col("quote_volume") - F.col("taker_quote"), 2), **signals.anatomy(), **signals.decision_clock(F.col("open_time_ms"), DAY_MS)})
    return rounded(x.select("symbol", "open_time_ms", "taker_ratio", "sell_quote", "upper_wick", "lower_wick", "aligned", "close_ms", "cutoff_ms"))


_FEES = ((0.0, 0.0), (1.0, 1.0), (2.0, 2.0))


@_register("f05_stressed_returns", f"""with {_BREAKS}, fees(fee, slip) as (values {', '.join(f'({a}::double, {b}::double)' for a, b in _FEES)}), x as (select z.symbol, z.open_time_ms, fee, z.direction, entry, entry * (1 + direction * slip * 0.0002::double) as paid, exit * (1 - direction * slip * 0.0002::double) as got, fee * 0.0004::double as f from z, fees)
 select symbol, open_time_ms, fee, {r('direction * (got - paid) / entry - f * (paid + got) / entry', 8)} as net_return from x""")
def f05(spark, d):
    x = _breaks(spark, d).select("symbol", "open_time_ms", "direction", "entry", "exit")
    nets = [F.struct(F.lit(a).alias("fee"), scalars.execution_returns(F.col("direction"), F.col("entry"), F.col("exit"), 4.0 * a, 2.0 * b)["net_return"].alias("net_return")) for a, b in _FEES]
    return rounded(x.select("symbol", "open_time_ms", F.inline(F.array(*nets))), 8)


@_register("f12_score_buckets", """with x as (select l_orderkey, l_linenumber, cast(round(l_quantity * 2) as bigint) as score, cast(round(l_discount * 100) as bigint) - 5 as part, cast(l_quantity as bigint) as whole from lineitem)
 select l_orderkey, l_linenumber, case when score < 25 then 'q1' when score < 50 then 'q2' when score < 75 then 'q3' else 'q4' end as bucket, cast(sign(part) * ((2 * abs(part) * 1000000 + whole) // (2 * whole)) as bigint) as ratio_micros, 0.025::double * pow(2.0::double, 1 - l_linenumber) as alpha from x""")
def f12(spark, d):
    score = F.round(F.col("l_quantity") * 2).cast("long")
    bucket = F.when(score < 25, "q1").when(score < 50, "q2").when(score < 75, "q3").otherwise("q4")
    part = F.round(F.col("l_discount") * 100).cast("long") - 5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bucket.alias("bucket"), signals.ratio_micros(part, F.col("l_quantity").cast("long")).alias("ratio_micros"), signals.attempt_alpha(F.col("l_linenumber")).alias("alpha"))


@_register("f18_sized_positions", f"with {TICKS} select agg_id, floor(1000.0::double / price * 100) / 100 as size, cast(round(price * 10000) as bigint) % 25 = 0 as on_tick from ticks")
def f18(spark, d):
    return ticks(spark, d).select("agg_id", signals.sized(1000.0, F.col("price"), 100).alias("size"), signals.tick_aligned(F.col("price"), 10_000, 25).alias("on_tick"))


@_register("f20_cost_survival", f"with recursive {_OSC} select symbol, open_time_ms, {r('0.0012::double * close / atr')} as cost_atr from osc where atr > 0")
def f20(spark, d):
    return rounded(_recursive(spark, d).where("atr > 0").select("symbol", "open_time_ms", (F.lit(0.0012) * F.col("close") / F.col("atr")).alias("cost_atr")))


@_register("w07_directional_movement", f"with recursive {_OSC} select symbol, open_time_ms, {r('plus_di', 5)} as plus_di, {r('minus_di', 5)} as minus_di, {r('adx', 5)} as adx, {r('adx - ' + _LAG('adx', 1), 5)} as adx_delta from osc")
def w07(spark, d):
    x = _recursive(spark, d).withColumn("adx_delta", F.col("adx") - F.lag("adx").over(series.segment()))
    return rounded(x.select("symbol", "open_time_ms", "plus_di", "minus_di", "adx", "adx_delta"), 5)


@_register("w15_slopes", f"with recursive {_OSC} select symbol, open_time_ms, {r('(ema20 - ' + _LAG('ema20', 3) + ') / atr', 5)} as ema20_slope_atr, {r('(close - ema20) / atr', 5)} as ema20_distance_atr from osc")
def w15(spark, d):
    return rounded(_recursive(spark, d).withColumns(signals.slopes()).select("symbol", "open_time_ms", "ema20_slope_atr", "ema20_distance_atr"), 5)


_TOP = lambda v, a, b: f"max({{'v': {v}, 'place': -open_time_ms, 'rsi': rsi}}) {_over(a, b)}"
_DIVERGENCE = f"tops as (select *, {_TOP('high', -29, -15)} as h1, {_TOP('high', -14, 0)} as h2, {_TOP('-low', -29, -15)} as l1, {_TOP('-low', -14, 0)} as l2 from osc)"
_BEARISH = "coalesce(rn >= 30 and h2.v > h1.v * 1.001::double and h2.rsi < h1.rsi - 2, false)"
_BULLISH = "coalesce(rn >= 30 and l2.v > l1.v * 0.999::double and l2.rsi > l1.rsi + 2, false)"


@_register("w16_divergences", f"with recursive {_OSC}, {_DIVERGENCE} select symbol, open_time_ms, {_BEARISH} as bearish_divergence, {_BULLISH} as bullish_divergence from tops where rsi is not null")
def w16(spark, d):
    x = _recursive(spark, d).withColumns(signals.divergences())
    return x.where("rsi is not null").select("symbol", "open_time_ms", "bearish_divergence", "bullish_divergence")


@_register("w42_feature_rows", f"""with recursive {_OSC}, {_DIVERGENCE} select symbol, open_time_ms, {', '.join(f"{r(c, 5)} as {c}" for c in ('ema9', 'ema20', 'ema50', 'rsi', 'atr', 'adx', 'macd_histogram'))}, {r('case when quote_volume > 0 then taker_quote / quote_volume end', 5)} as taker_ratio,
 {_BEARISH} as bearish_divergence, {_BULLISH} as bullish_divergence from tops where rn >= 210""")
def w42(spark, d):
    x = _recursive(spark, d).withColumns({"rn": F.row_number().over(series.segment()), "taker_ratio": scalars.flow_ratio(F.col("taker_quote"), F.col("quote_volume")), **signals.divergences()})
    return rounded(x.where("rn >= 210").select("symbol", "open_time_ms", "ema9", "ema20", "ema50", "rsi", "atr", "adx", "macd_histogram", "taker_ratio", "bearish_divergence", "bullish_divergence"), 5)


_TWO = f"{TICKS}, h as (select symbol, is_buyer_maker as spot, ts_ms - ts_ms % {HOUR_MS} as open_time_ms, arg_max(price, agg_id) as close from ticks group by 1, 2, 3)"


@_register("j04_aligned_basis", f"with {_TWO} select s.symbol, s.open_time_ms, {r('(f.close - s.close) / s.close', 8)} as basis from h s join h f on s.symbol = f.symbol and s.open_time_ms = f.open_time_ms and s.spot and not f.spot")
def j04(spark, d):
    h = ticks(spark, d).groupBy("symbol", "is_buyer_maker", F.expr(f"ts_ms - pmod(ts_ms, {HOUR_MS}L)").alias("open_time_ms")).agg(F.max_by("price", "agg_id").alias("close"))
    side = lambda spot, name: h.where("is_buyer_maker" if spot else "not is_buyer_maker").select("symbol", "open_time_ms", F.col("close").alias(name))
    x = side(True, "s").join(side(False, "f"), ["symbol", "open_time_ms"])
    return rounded(x.select("symbol", "open_time_ms", ((F.col("f") - F.col("s")) / F.col("s")).alias("basis")), 8)


@_register("j10_horizon_outcome", f"with {candles_sql()}, x as (select symbol, open_time_ms, close, max(high) over w as h, min(low) over w as l, last_value(close) over w as c from candles window w as (partition by symbol order by open_time_ms range between {DAY_MS} following and {7 * DAY_MS} following)) select symbol, open_time_ms, {r('h / close - 1')} as highest, {r('l / close - 1')} as lowest, {r('c / close - 1')} as final from x where c is not null")
def j10(spark, d):
    return rounded(signals.horizon_outcome(candles(spark, d), DAY_MS, 7 * DAY_MS))


_ENTRIES = f"{candles_sql()}, e as (select symbol, open_time_ms, case when close > open then 1 else -1 end as direction, lead(open) over (partition by symbol order by open_time_ms) as entry, case when trade_count % 9 = 0 then null when close > open then low else high end as invalidation from candles)"


@_register("j11_first_touch", f"""with {_ENTRIES}, v as (select *, 2 * entry - invalidation as target, coalesce(direction * (entry - invalidation) > 0 and invalidation > 0 and 2 * entry - invalidation > 0, false) as valid from e where entry is not null),
 p as (select v.symbol, v.open_time_ms, c.open_time_ms as o, case when direction * (c.open - target) >= 0 then 'TARGET_FIRST' when direction * (c.open - invalidation) <= 0 then 'INVALIDATION_FIRST' end as at_open,
 direction * ((case when direction > 0 then high else low end) - target) >= 0 as hit, direction * ((case when direction > 0 then low else high end) - invalidation) <= 0 as lost from v join candles c on v.valid and c.symbol = v.symbol and c.open_time_ms > v.open_time_ms and c.open_time_ms <= v.open_time_ms + {12 * DAY_MS}),
 s as (select *, coalesce(at_open, case when hit and lost then 'COLLISION' when hit then 'TARGET_FIRST' when lost then 'INVALIDATION_FIRST' end) as status, case when at_open is null then o + {DAY_MS - 1} else o end as touched from p),
 f as (select symbol, open_time_ms, arg_min(status, o) filter (status is not null) as status, arg_min(touched, o) filter (status is not null) as touched, max(o) + {DAY_MS - 1} as last from s group by 1, 2)
 select v.symbol, v.open_time_ms, case when valid then coalesce(status, 'TIMEOUT') else 'INVALID_INVALIDATION' end as status, case when valid then coalesce(touched, last) end as at_ms from v left join f on v.symbol = f.symbol and v.open_time_ms = f.open_time_ms""")
def j11(spark, d):
    c = candles(spark, d)
    up = F.col("close") > F.col("open")
    e = c.select("symbol", "open_time_ms", F.when(up, 1).otherwise(-1).alias("direction"), F.lead("open").over(series.key()).alias("entry"), F.when(F.col("trade_count") % 9 == 0, None).when(up, F.col("low")).otherwise(F.col("high")).alias("invalidation"))
    return signals.first_touch(e.where("entry is not null"), c, DAY_MS, 12).select("symbol", "open_time_ms", "status", "at_ms")


@_register("j17_regime", f"""with recursive {_OSC}, b as (select symbol, open_time_ms, lag(close) over k > lag(close, 2) over k as up, case when symbol = 'A' then lag(close) over k end as price, case when symbol = 'A' then lag(ema20) over k end as fast, case when symbol = 'A' then lag(ema50) over k end as slow from osc window k as (partition by symbol order by open_time_ms)),
 m as (select open_time_ms, coalesce(avg(up::int), 0.5::double) as breadth, max(price) as price, max(fast) as fast, max(slow) as slow from b group by 1), rg as (select open_time_ms, breadth, case when price > fast and fast > slow then 'bullish' when price < fast and fast < slow then 'bearish' else 'neutral' end as trend from m)
 select open_time_ms, {r('breadth')} as breadth, trend, case when trend = 'bullish' and breadth >= 0.55::double then 'risk_on' when trend = 'bearish' and breadth <= 0.45::double then 'risk_off' else 'neutral' end as label from rg""")
def j17(spark, d):
    back = lambda c, n=1: F.lag(c, n).over(series.key())
    lead = lambda c: F.max(F.when(F.col("symbol") == "A", F.col(c)))
    x = _recursive(spark, d).select("symbol", "open_time_ms", (back("close") > back("close", 2)).cast("int").alias("up"), back("close").alias("price"), back("ema20").alias("fast"), back("ema50").alias("slow"))
    g = x.groupBy("open_time_ms").agg(F.coalesce(F.avg("up"), F.lit(0.5)).alias("breadth"), signals.stack_trend(lead("price"), lead("fast"), lead("slow")).alias("trend"))
    return rounded(g.select("open_time_ms", "breadth", "trend", signals.regime(F.col("breadth"), F.col("trend")).alias("label")))


@_register("j20_beta", f"with {candles_sql()}, x as (select symbol, open_time_ms, ln(close / open) as v from candles), m as (select open_time_ms, median(v) as m from x group by 1) select symbol, {r('greatest(0.25::double, least(2.5::double, covar_pop(v, m) / var_pop(m)))')} as beta from x join m using (open_time_ms) group by 1")
def j20(spark, d):
    x = candles(spark, d).select("symbol", "open_time_ms", F.log(F.col("close") / F.col("open")).alias("v"))
    m = x.groupBy("open_time_ms").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return rounded(x.join(m, "open_time_ms").groupBy("symbol").agg(signals.population_beta("v", "m").alias("beta")))


_NOW_MS = 883612800000
_DELIVERY = f"d as (select o_orderkey, o_orderpriority, epoch_ms(cast(o_orderdate as timestamp)) + {60 * DAY_MS} as target from orders), l as (select l_orderkey, min(epoch_ms(cast(l_shipdate as timestamp))) as got from lineitem group by 1), c as (select o_orderkey, o_orderpriority, case when got <= target then 'on_time' when got <= target + {30 * DAY_MS} then 'late' when got is null and {_NOW_MS} <= target + {30 * DAY_MS} then 'pending' else 'missing' end as state from d left join l on o_orderkey = l_orderkey)"


def _delivery(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (epoch_ms("o_orderdate") + 60 * DAY_MS).alias("target"))
    got = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(epoch_ms("l_shipdate")).alias("got"))
    state = signals.delivery_class(F.col("target"), F.col("got"), F.lit(_NOW_MS), 30 * DAY_MS)
    return orders.join(got, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", state.alias("state"))


@_register("j24_reconcile", f"with {_DELIVERY} select o_orderkey, state from c")
def j24(spark, d):
    return _delivery(spark, d).select("o_orderkey", "state")


@_register("a25_actionability", f"with {_DELIVERY}, s as (select o_orderpriority, count(*) as n, count(*) filter (state = 'on_time') as on_time, count(*) filter (state = 'pending') as pending from c group by 1) select *, case when n = 0 or pending > 0 then 'INCONCLUSIVE' when on_time * 100 >= n * 99 then 'PASS' else 'FAIL' end as verdict from s")
def a25(spark, d):
    x = _delivery(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "on_time").alias("on_time"), F.count_if(F.col("state") == "pending").alias("pending"))
    return x.withColumn("verdict", signals.actionability_gate(F.col("on_time"), F.col("n"), F.col("pending")))


@_register("r24_spot_priority", f"with {TICKS}, k as (select symbol, user_id, ts_ms - ts_ms % {HOUR_MS} as slot_ms, agg_id, is_buyer_maker as spot, row_number() over (partition by symbol, user_id, ts_ms - ts_ms % {HOUR_MS} order by not is_buyer_maker, agg_id) as k, count(*) over (partition by symbol, user_id, ts_ms - ts_ms % {HOUR_MS}) as n_rows from ticks) select symbol, user_id, slot_ms, agg_id, spot, n_rows from k where k = 1")
def r24(spark, d):
    x = ticks(spark, d).select("symbol", "user_id", F.expr(f"ts_ms - pmod(ts_ms, {HOUR_MS}L)").alias("slot_ms"), "agg_id", F.col("is_buyer_maker").alias("spot"))
    return signals.first_of_key(x, ["symbol", "user_id", "slot_ms"], [~F.col("spot"), F.col("agg_id")])


_REPS = 200
_WHOLE = f"""{PRINTS}, bl as (select symbol, ts_ms // {30 * DAY_MS} as b, cast(sum(drift) as bigint) as s, count(*) as c from prints group by 1, 2), p as (select *, row_number() over (partition by symbol order by b) - 1 as place, count(*) over (partition by symbol) as n from bl),
 dr as (select symbol, n, rep, unnest(range(n)) as i from (select distinct symbol, n from p) y, range({_REPS}) as x(rep)), pick as (select symbol, rep, cast(('0x' || substr(md5('11|' || rep || '|' || i), 1, 8)) as bigint) % n as place from dr),
 m as (select pick.symbol, rep, cast(sum(s) as double) / cast(sum(c) as double) as mean from pick join p on p.symbol = pick.symbol and p.place = pick.place group by 1, 2)"""


def _whole_blocks(spark, d):
    x = prints(spark, d).groupBy("symbol", F.expr(f"ts_ms div {30 * DAY_MS}").alias("b")).agg(F.sum("drift").alias("s"), F.count("*").alias("c"))
    return x.withColumn("place", (F.row_number().over(Window.partitionBy("symbol").orderBy("b")) - 1).cast("long"))


@_register("b02_whole_blocks", f"with {_WHOLE}, k as (select *, row_number() over (partition by symbol order by mean) - 1 as k, count(*) over (partition by symbol) - 1 as n from m) select symbol, {r('max(mean) filter (k = floor(n * 0.025::double))')} as low, {r('max(mean) filter (k = ceil(n * 0.975::double))')} as high from k group by 1")
def b02(spark, d):
    return rounded(signals.order_statistics(signals.whole_block_means(_whole_blocks(spark, d), "symbol", _REPS, 11), "symbol"))


@_register("b09_basic_bound", f"with {_WHOLE}, pt as (select symbol, cast(sum(s) as double) / cast(sum(c) as double) - 5 as point from p group by 1), y as (select m.symbol, mean - 5 as mean, point from m join pt on m.symbol = pt.symbol) select symbol, {r('first(point)')} as point, {r('2 * first(point) - quantile_cont(mean, 0.95)')} as lower, {r('(count(*) filter (mean - point >= point) + 1) / cast(count(*) + 1 as double)')} as p_value from y group by 1")
def b09(spark, d):
    blocks = _whole_blocks(spark, d)
    means = signals.whole_block_means(blocks, "symbol", _REPS, 11).withColumn("mean", F.col("mean") - 5)
    return rounded(signals.basic_bound(means, blocks.groupBy("symbol").agg((F.sum("s") / F.sum("c") - 5).alias("point")), "symbol"))


@_register("o06_conflicts", "with x as (select user_id, event_type, props, count(*) as c from events group by 1, 2, 3) select user_id, event_type, cast(sum(c) as bigint) as n, count(*) as kinds, case when count(*) > 1 then 'conflict' when sum(c) > 1 then 'duplicate' else 'single' end as state from x group by 1, 2")
def o06(spark, d):
    return signals.conflicts(table(spark, d, "events"), ["user_id", "event_type"], ["props"])


_BOOK = "lv as (select l_suppkey, case when l_linestatus = 'O' then 'ask' else 'bid' end as side, round(100000 + case when l_linestatus = 'O' then 1 else -1 end * l_extendedprice / 100, 2) as price, l_quantity as qty from lineitem)"


@_register("c04_book_tops", f"with {_BOOK}, tp as (select l_suppkey, max(price) filter (side = 'bid') as bid, min(price) filter (side = 'ask') as ask from lv group by 1), md as (select *, (bid + ask) / 2 as mid from tp where bid < ask) select md.l_suppkey, bid, ask, mid, {r('(ask - bid) / mid * 10000')} as spread_bps, {r('coalesce(sum(case when side = ' + chr(39) + 'bid' + chr(39) + ' and price >= mid * (1 - 0.001::double) then price * qty end), 0)', 2)} as bid_depth, {r('coalesce(sum(case when side = ' + chr(39) + 'ask' + chr(39) + ' and price <= mid * (1 + 0.001::double) then price * qty end), 0)', 2)} as ask_depth from lv join md on lv.l_suppkey = md.l_suppkey group by 1, 2, 3, 4")
def c04(spark, d):
    ask = F.col("l_linestatus") == "O"
    levels = table(spark, d, "lineitem").select("l_suppkey", F.when(ask, "ask").otherwise("bid").alias("side"), F.round(100000 + F.when(ask, 1).otherwise(-1) * F.col("l_extendedprice") / 100, 2).alias("price"), F.col("l_quantity").alias("qty"))
    x = signals.book_tops(levels, ["l_suppkey"])
    return x.select("l_suppkey", "bid", "ask", "mid", (F.round("spread_bps", 6) + F.lit(0.0)).alias("spread_bps"), (F.round("bid_depth", 2) + F.lit(0.0)).alias("bid_depth"), (F.round("ask_depth", 2) + F.lit(0.0)).alias("ask_depth"))


@_register("c02_snapshot_bridge", """with ev as (select event_type as symbol, event_id // 500 as snap, event_id as seq, event_id + user_id % 60 as first_id, event_id + user_id % 60 + 20 as final_id from events), sn as (select symbol, snap, min(seq) + cast(snap % 90 as bigint) + 40 as last_id from ev group by 1, 2),
 x as (select sn.symbol, sn.snap, sn.last_id, count(*) filter (final_id <= last_id) as discarded, arg_min(first_id, seq) filter (final_id > last_id) as next_id from sn left join ev on ev.symbol = sn.symbol and ev.snap = sn.snap group by 1, 2, 3) select symbol, snap, case when next_id is null then 'waiting' when next_id <= last_id + 1 then 'accepted' else 'stale' end as state, discarded from x""")
def c02(spark, d):
    first = F.col("event_id") + F.col("user_id") % 60
    ev = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.expr("event_id div 500").alias("snap"), F.col("event_id").alias("seq"), first.alias("first_id"), (first + 20).alias("final_id"))
    snaps = ev.groupBy("symbol", "snap").agg((F.min("seq") + F.col("snap") % 90 + 40).alias("last_id"))
    return signals.bridge(snaps, ev, ["symbol", "snap"])


@_register("t11_admission", f"with {TICKS}, x as (select agg_id, ts_ms, ts_ms + agg_id % 3000 - case when agg_id % 97 = 0 then 5000 else 0 end as receipt, ts_ms - ts_ms % {HOUR_MS} + {HOUR_MS // 2} as cutoff from ticks) select agg_id, case when ts_ms > cutoff then 'EVENT_AFTER_CUTOFF' when receipt > cutoff then 'RECEIPT_AFTER_CUTOFF' when receipt < ts_ms then 'RECEIPT_PRECEDES_EVENT' end as reason from x")
def t11(spark, d):
    n = F.col("agg_id")
    x = ticks(spark, d).select("agg_id", "ts_ms", (F.col("ts_ms") + n % 3000 - F.when(n % 97 == 0, 5000).otherwise(0)).alias("receipt"), F.expr(f"ts_ms - pmod(ts_ms, {HOUR_MS}L) + {HOUR_MS // 2}").alias("cutoff"))
    return x.select("agg_id", signals.admission(F.col("ts_ms"), F.col("receipt"), F.col("cutoff")).alias("reason"))


@_register("t13_sessions", f"with {TICKS}, g as (select symbol, user_id, ts_ms, price, case when ts_ms - lag(ts_ms) over (partition by symbol, user_id order by ts_ms) < {12 * HOUR_MS} then 0 else 1 end as fresh from ticks), s as (select *, sum(fresh) over (partition by symbol, user_id order by ts_ms rows unbounded preceding) as k from g) select symbol, user_id, min(ts_ms) as start_ms, max(ts_ms) + {12 * HOUR_MS} as end_ms, count(*) as n from s group by symbol, user_id, k")
def t13(spark, d):
    x = ticks(spark, d).withColumn("at", F.timestamp_millis("ts_ms"))
    x = x.groupBy("symbol", "user_id", F.session_window("at", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return x.select("symbol", "user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")
