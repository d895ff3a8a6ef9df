"""Registered queries of strict records, alignment, sign panels, sorted windows and sensitivity; they join the registry of ``market``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, kernels, records, series, signals
from ..sources import decode
from .market import _BREAKS, _OFF_TIES, _SEG, _breaks, _over, _register, r, rounded
from .views import DAY_MS, FUNDING, HOUR_MS, PRINTS, TICKS, candles, funding, prints, table, ticks


@_register("s07_strict_rates", f"with {TICKS} select symbol, count(*) as n, count(*) filter (agg_id % 11 <> 0 and agg_id % 13 <> 0 and agg_id % 17 <> 0) as valid, {r('sum(case when agg_id % 11 <> 0 and agg_id % 13 <> 0 and agg_id % 17 <> 0 then (agg_id % 100) / 1000.0::double end)')} as rates from ticks group by 1")
def s07(spark, d):
    n = F.col("agg_id")
    name = F.when(n % 11 == 0, "other").otherwise(F.col("symbol"))
    time = F.when(n % 13 == 0, "soon").otherwise(F.col("ts_ms").cast("string"))
    rate = F.when(n % 17 == 0, "NaN").otherwise(((n % 100) / 1000.0).cast("string"))
    body = F.to_json(F.struct(name.alias("symbol"), time.alias("fundingTime"), rate.alias("fundingRate")))
    x = records.strict_rates(ticks(spark, d).select("symbol", body.alias("body")), "symbol", "body")
    return rounded(x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.sum(F.when(F.col("valid"), F.col("rate"))).alias("rates")))


@_register("s09_depth_rows", f"with {TICKS} select agg_id, agg_id % 19 <> 0 and agg_id % 23 <> 0 as valid, cast(2 + agg_id % 2 as integer) as n_bids, case when agg_id % 19 = 0 then null else {r('price * qty + (price - 1) * 2 * qty + case when agg_id % 2 = 1 then (price - 2) * 3 * qty else 0 end', 4)} end as bid_quote from ticks")
def s09(spark, d):
    n, price, qty = F.col("agg_id"), F.col("price"), F.col("qty")
    text = lambda x: x.cast("string")
    level = lambda i: F.array(F.when(n % 19 == 0, "x").otherwise(text(F.round(price - i, 4))), text(qty * (i + 1)))
    bids = F.when(n % 2 == 1, F.array(level(0), level(1), level(2))).otherwise(F.array(level(0), level(1)))
    body = F.to_json(F.struct(n.alias("U"), (n + 4).alias("u"), F.when(n % 23 == 0, n + 9).otherwise(n - 1).alias("pu"), bids.alias("b"), F.array(F.array(text(price + 1), text(qty))).alias("a")))
    x = records.depth_rows(ticks(spark, d).select("agg_id", body.alias("body")), "body")
    quote = F.aggregate("bids", F.lit(0.0), lambda s, b: s + b["price"] * b["qty"])
    return x.select("agg_id", "valid", F.size("bids").alias("n_bids"), (F.round(quote, 4) + F.lit(0.0)).alias("bid_quote"))


@_register("s15_outcome_upsert", "with x as (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by event_id % 3 desc, event_id desc) as k from events) select user_id, event_type, event_id, value from x where k = 1")
def s15(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", (F.col("event_id") % 3 * 10_000_000_000 + F.col("event_id")).alias("version"))
    old, new = e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")
    return decode.upsert(old, new, ["user_id", "event_type"], "version").select("user_id", "event_type", "event_id", "value")


@_register("s18_frames", f"with {TICKS} select symbol, agg_id % 3 = 0 as encoded, count(*) as n, count(*) filter (agg_id % 5 <> 0) as known from ticks group by 1, 2")
def s18(spark, d):
    n = F.col("agg_id")
    text = F.to_json(F.struct(F.when(n % 5 == 0, "unasked").otherwise(F.col("symbol")).alias("stream"), F.struct("price").alias("data")))
    x = ticks(spark, d).select("symbol", F.when(n % 3 == 0, F.base64(text.cast("binary"))).otherwise(text).alias("payload"), F.when(n % 3 == 0, "base64").otherwise("text").alias("encoding"), F.array("symbol").alias("subscribed"))
    x = records.frames(x, "payload", "encoding", "subscribed")
    return x.groupBy("symbol", (F.col("encoding") == "base64").alias("encoded")).agg(F.count("*").alias("n"), F.count_if("known").alias("known"))


@_register("u02_sorted_window", f"with {TICKS}, p as (select symbol, agg_id, price, row_number() over w as rn, list(price) over (partition by symbol order by agg_id rows between 300 preceding and 1 preceding) as past from ticks window w as (partition by symbol order by agg_id)), m as (select *, list_aggregate(past, 'quantile_cont', 0.5) as med from p where rn > 300) select symbol, agg_id, {r('med')} as prior_median, {r('list_aggregate(list_transform(past, lambda v: abs(v - med)), ' + chr(39) + 'quantile_cont' + chr(39) + ', 0.5)')} as prior_mad, {r('len(list_filter(past, lambda v: v <= price)) / 300.0::double')} as prior_ecdf from m")
def u02(spark, d):
    x = records.sorted_window(ticks(spark, d).select("symbol", "agg_id", "price"), ["symbol"], ["agg_id"], "price", 300, 1000, 10_000)
    return rounded(x.where("prior_median is not null").select("symbol", "agg_id", "prior_median", "prior_mad", "prior_ecdf"))


@_register("w37_volatility_regime", f"with {_SEG}, p as (select *, list(true_range) {_over(-60, -1)} as past from t), m as (select *, list_aggregate(past, 'quantile_cont', 0.5) as med from p where rn > 60), a as (select *, list_aggregate(list_transform(past, lambda v: abs(v - med)), 'quantile_cont', 0.5) as mad from m) select symbol, open_time_ms, {r('(true_range - med) / (mad * 1.4826::double)', 4)} as z from a where mad > 0")
def w37(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS).withColumn("true_range", series.true_range()).select("symbol", "seg", "open_time_ms", "true_range")
    x = records.sorted_window(x, ["symbol", "seg"], ["open_time_ms"], "true_range", 60, bucket=kernels.COUNT_MS)
    return rounded(x.where("prior_mad > 0").select("symbol", "open_time_ms", ((F.col("true_range") - F.col("prior_median")) / (F.col("prior_mad") * 1.4826)).alias("z")), 4)


@_register("j13_variant_alignment", "with l as (select event_id, event_type, user_id from events where event_id % 7 <> 0), r as (select event_id, case when event_id % 5 = 0 then 'other' else event_type end as event_type, user_id from events where event_id % 11 <> 0) select coalesce(l.event_id, r.event_id) as event_id, case when r.event_id is null then 'left_only' when l.event_id is null then 'right_only' when l.event_type = r.event_type and l.user_id = r.user_id then 'same' else 'changed' end as state from l full join r on l.event_id = r.event_id")
def j13(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    changed = e.withColumn("event_type", F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")))
    return records.aligned(e.where("event_id % 7 <> 0"), changed.where("event_id % 11 <> 0"), ["event_id"], ["event_type", "user_id"])


@_register("j14_orphans", "with o as (select o_orderkey from orders where o_orderkey % 9 <> 0) select l_orderkey, count(*) as n from lineitem anti join o on l_orderkey = o_orderkey group by 1")
def j14(spark, d):
    orders = table(spark, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(orders, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


_LEAVES = {"price_leaf": "sign(close - open)", "flow_leaf": "sign(2 * taker_quote - quote_volume)", "size_leaf": "sign(trade_count - lag(trade_count) over (partition by symbol order by open_time_ms))"}
_SIGNS = f"{_SEG}, sg as (select symbol, open_time_ms, {', '.join(f'cast(coalesce({v}, 0) as integer) as {k}' for k, v in _LEAVES.items())} from candles)"


def _signs(spark, d):
    move = {"price_leaf": F.col("close") - F.col("open"), "flow_leaf": 2 * F.col("taker_quote") - F.col("quote_volume"), "size_leaf": F.col("trade_count") - F.lag("trade_count").over(series.key())}
    return candles(spark, d).select("symbol", "open_time_ms", *(F.coalesce(F.signum(v.cast("double")), F.lit(0.0)).cast("int").alias(k) for k, v in move.items()))


_RELATION = lambda a, b: f"case when {a} = 0 or {b} = 0 then 'neutral' when {a} = {b} then 'aligned' else 'opposed' end"


@_register("j25_relation", f"with {_SIGNS} select symbol, open_time_ms, {_RELATION('price_leaf', 'flow_leaf')} as relation from sg")
def j25(spark, d):
    return _signs(spark, d).select("symbol", "open_time_ms", records.relation(F.col("price_leaf"), F.col("flow_leaf")).alias("relation"))


_COUNT = lambda v: "(" + " + ".join(f"({k} = {v})::int" for k in _LEAVES) + ")"


@_register("r22_topology", f"with {_SIGNS} select symbol, open_time_ms, {_COUNT(1)} || '+' || {_COUNT(-1)} || '-' || {_COUNT(0)} || '=' as topology, case when {_COUNT(1)} > {_COUNT(-1)} then 'long' when {_COUNT(1)} < {_COUNT(-1)} then 'short' else 'none' end as majority from sg")
def r22(spark, d):
    x = _signs(spark, d)
    total = sum((F.col(k) for k in _LEAVES), F.lit(0))
    return x.select("symbol", "open_time_ms", records.topology([F.col(k) for k in _LEAVES]).alias("topology"), F.when(total > 0, "long").when(total < 0, "short").otherwise("none").alias("majority"))


@_register("a16_pair_rates", f"with {_SIGNS} " + " union all ".join(f"select symbol, '{a}/{b}' as pair, {_RELATION(a, b)} as relation, count(*) as n from sg group by 1, 2, 3" for i, a in enumerate(_LEAVES) for b in list(_LEAVES)[i + 1 :]))
def a16(spark, d):
    return records.pair_rates(_signs(spark, d), ["symbol"], list(_LEAVES))


_NET = lambda s: f"(net_return - {s}::double)"


@_register("a12_carry_summary", f"with {_BREAKS} " + " union all ".join(f"select symbol, '{name}' as variant, count(*) as n, {r(f'sum({_NET(s)})')} as total, {r(f'avg({_NET(s)})')} as mean, {r(f'quantile_cont({_NET(s)}, 0.5)')} as median, count(*) filter ({_NET(s)} > 0) as winners from z group by 1" for name, s in (("base", "0.0"), ("stress", "0.001"))))
def a12(spark, d):
    x = _breaks(spark, d).select("symbol", F.inline(F.array(*(F.struct(F.lit(name).alias("variant"), (F.col("net_return") - s).alias("net")) for name, s in (("base", 0.0), ("stress", 0.001))))))
    return rounded(x.groupBy("symbol", "variant").agg(F.count("*").alias("n"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.percentile("net", F.lit(0.5)).alias("median"), F.count_if(F.col("net") > 0).alias("winners")))


@_register("a26_funding_cashflow", f"with {FUNDING}, e as (select agg_id, symbol, case when is_buyer_maker then -1 else 1 end * qty * price as notional, ts_ms, ts_ms + (1 + agg_id % 72) * {HOUR_MS} as exit_ms from ticks) select e.agg_id, {r(f'-notional * coalesce(sum(f.rate), 0) + {_OFF_TIES}::double', 3)} as cashflow from e left join funding f on e.symbol = f.symbol and f.funding_time_ms > e.ts_ms and f.funding_time_ms < e.exit_ms group by e.agg_id, notional")
def a26(spark, d):
    e = ticks(spark, d).select("agg_id", "symbol", (F.when(F.col("is_buyer_maker"), -1).otherwise(1) * F.col("qty") * F.col("price")).alias("notional"), "ts_ms", (F.col("ts_ms") + (1 + F.col("agg_id") % 72) * HOUR_MS).alias("exit_ms"))
    x = joins.interval_sum(e, funding(spark, d), ["symbol"], "ts_ms", "exit_ms", "funding_time_ms", F.col("rate"), "rates", DAY_MS)
    return rounded(x.select("agg_id", (-F.col("notional") * F.col("rates") + _OFF_TIES).alias("cashflow")), 3)


@_register("r25_selections", f"with {_BREAKS} select 'long' as selection, symbol, open_time_ms from z where direction = 1 union all select 'favourable', symbol, open_time_ms from z where mfe > 0.01::double union all select 'calm', symbol, open_time_ms from z where mae > -0.02::double")
def r25(spark, d):
    x = records.selections(_breaks(spark, d), {"long": F.col("direction") == 1, "favourable": F.col("mfe") > 0.01, "calm": F.col("mae") > -0.02})
    return x.select("selection", "symbol", "open_time_ms")


_LENGTHS = (15, 30, 60)


@_register("b08_block_lengths", f"with {PRINTS}, bl as (select days, symbol, ts_ms // (days * {DAY_MS}) as b, cast(sum(drift) as bigint) as s, count(*) as c from prints, (values {', '.join(f'({x}::bigint)' for x in _LENGTHS)}) as y(days) group by 1, 2, 3), p as (select *, row_number() over (partition by days, symbol order by b) - 1 as place, count(*) over (partition by days, symbol) as n from bl), dr as (select days, symbol, n, rep, unnest(range(n)) as i from (select distinct days, symbol, n from p) y, range(100) as x(rep)), pick as (select days, symbol, rep, cast(('0x' || substr(md5('11|' || rep || '|' || i), 1, 8)) as bigint) % n as place from dr), m as (select pick.days, pick.symbol, rep, cast(sum(s) as double) / cast(sum(c) as double) as mean from pick join p on p.days = pick.days and p.symbol = pick.symbol and p.place = pick.place group by 1, 2, 3), k as (select *, row_number() over (partition by days, symbol order by mean) - 1 as k, count(*) over (partition by days, symbol) - 1 as n from m) select cast(days as integer) as days, symbol, {r('max(mean) filter (k = floor(n * 0.025::double))')} as low, {r('max(mean) filter (k = ceil(n * 0.975::double))')} as high from k group by 1, 2")
def b08(spark, d):
    def one(days: int):
        x = prints(spark, d).groupBy("symbol", F.expr(f"ts_ms div {days * DAY_MS}").alias("b")).agg(F.sum("drift").alias("s"), F.count("*").alias("c"))
        x = x.withColumn("place", (F.row_number().over(Window.partitionBy("symbol").orderBy("b")) - 1).cast("long"))
        return rounded(signals.order_statistics(signals.whole_block_means(x, "symbol", 100, 11), "symbol")).select(F.lit(days).alias("days"), "symbol", "low", "high")

    return reduce(lambda a, b: a.unionByName(b), map(one, _LENGTHS))


@_register("t12_late_conflicts", f"with {TICKS}, x as (select symbol, ts_ms - ts_ms % {DAY_MS} as slot_ms, ts_ms, ts_ms + agg_id % 5000 as receipt, ts_ms - ts_ms % {DAY_MS} + {DAY_MS // 2} as cutoff, floor(price) as v from ticks), f as (select *, ts_ms <= cutoff and receipt <= cutoff as ok from x), z as (select symbol, slot_ms, max({{'t': ts_ms, 'r': receipt, 'v': v}}) filter (ok) as best from f group by 1, 2) select f.symbol, f.slot_ms, best.v as frozen, count(*) filter (not ok) as n_late, count(*) filter (not ok and f.v <> best.v) as n_conflicts from f join z on f.symbol = z.symbol and f.slot_ms = z.slot_ms group by 1, 2, 3")
def t12(spark, d):
    day = F.expr(f"ts_ms - pmod(ts_ms, {DAY_MS}L)")
    x = ticks(spark, d).select("symbol", day.alias("slot_ms"), "ts_ms", (F.col("ts_ms") + F.col("agg_id") % 5000).alias("receipt"), (day + DAY_MS // 2).alias("cutoff"), F.floor("price").cast("double").alias("v"))
    return records.late_conflicts(x, ["symbol", "slot_ms"], "ts_ms", "receipt", "cutoff", "v")
