"""Registered queries of paths, series checks, contexts, picks and episodes; they join the registry of ``market``."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates, joins
from .market import _BREAKS, _breaks, _register, r, rounded
from .views import DAY_MS, TICKS, candles, candles_sql, epoch_ms, table, ticks


@_register("p10_monotone_trades", f"with {TICKS}, a as (select symbol, agg_id, ts_ms + agg_id * 7919 % 7200000 as arrival from ticks), b as (select *, max(agg_id) over (partition by symbol order by arrival, agg_id rows between unbounded preceding and 1 preceding) as before from a) select symbol, agg_id from b where before is null or agg_id > before")
def p10(spark, d):
    x = ticks(spark, d).select("symbol", "agg_id", (F.col("ts_ms") + F.col("agg_id") * 7919 % 7200000).alias("arrival"))
    return gates.monotone(x, "symbol", ["arrival", "agg_id"], "agg_id").drop("arrival")


#: A day on which the venue of the series changes.
_MOVE_MS = 820454400000 + 14 * DAY_MS


@_register("p17_path_failures", f"""with {candles_sql()}, dated as (select *, open_time_ms // {DAY_MS} as day from candles), x as (select symbol, strftime(make_timestamp(open_time_ms * 1000), '%Y-%m') as month, open_time_ms, close_time_ms, close, open_time_ms < {_MOVE_MS} as venue, day % 83 <> 82 as closed,
 close_time_ms + day % 700 - case when day % 79 = 78 then 800 else 0 end as event_ms, close_time_ms + day % 700 + case when day % 73 = 72 then -900 else day % 1500 end as receipt_ms, open + case when day % 71 = 70 then 1 else 0 end as previous_close from dated),
 l as (select *, last_value(venue) over p as last_venue, last_value(close_time_ms) over p as last_close_ms, lag(open_time_ms) over w as po, lag(close) over w as pc from x window w as (partition by symbol, month order by open_time_ms, event_ms), p as (partition by symbol, month order by open_time_ms, event_ms rows between current row and unbounded following)),
 f as (select *, case when venue <> last_venue then 'IDENTITY_DRIFT' when open_time_ms % {DAY_MS} <> 0 or close_time_ms <> open_time_ms + {DAY_MS - 1} or not closed then 'ROW_NOT_CLOSED' when event_ms < close_time_ms then 'EVENT_PRECEDES_CLOSE' when receipt_ms < event_ms then 'RECEIPT_PRECEDES_EVENT'
 when receipt_ms > last_close_ms + 2000 then 'RECEIPT_AFTER_CUTOFF' when open_time_ms <> po + {DAY_MS} then 'GAP_OR_DUPLICATE' when previous_close <> pc then 'CLOSE_CHAIN_MISMATCH' end as code from l)
 select symbol, month, count(*) as n, max(event_ms) as latest_event_ms, max(receipt_ms) as latest_receipt_ms, arg_min(code, open_time_ms) filter (code is not null) as failure from f group by 1, 2""")
def p17(spark, d):
    n = F.expr(f"open_time_ms div {DAY_MS}")
    x = candles(spark, d).withColumns(
        {
            "month": F.date_format(F.timestamp_millis("open_time_ms"), "yyyy-MM"),
            "venue": F.col("open_time_ms") < _MOVE_MS,
            "closed": n % 83 != 82,
            "event_ms": F.col("close_time_ms") + n % 700 - F.when(n % 79 == 78, 800).otherwise(0),
            "receipt_ms": F.col("close_time_ms") + n % 700 + F.when(n % 73 == 72, -900).otherwise(n % 1500),
            "previous_close": F.col("open") + F.when(n % 71 == 70, 1).otherwise(0),
        }
    )
    return gates.path_failures(x, ["symbol", "month"], ["venue"], DAY_MS, 2000)


_FROM_MS, _TO_MS = 788918400000, 1735689600000


@_register("p19_series_check", f"with {TICKS}, e as (select symbol, ts_ms, count(*) as c, count(*) filter (not isfinite(price)) as bad from ticks group by 1, 2), g as (select symbol, cast(sum(c) as bigint) as n, cast(sum(case when ts_ms between {_FROM_MS} and {_TO_MS} then 0 else c end) as bigint) as outside, cast(sum(c - 1) as bigint) as repeated, cast(sum(bad) as bigint) as not_finite from e group by 1) select *, outside = 0 and repeated = 0 and not_finite = 0 as accepted from g")
def p19(spark, d):
    return gates.series_check(ticks(spark, d), "symbol", "ts_ms", "price", _FROM_MS, _TO_MS)


def _context(bars: DataFrame, days: int, name: str) -> DataFrame:
    """Closed bars of so many days with a fast and a slow mean; the slow one is null until it is full."""
    step = days * DAY_MS
    x = bars.groupBy("symbol", (F.col("open_time_ms") - F.col("open_time_ms") % step + (step - 1)).alias(f"{name}_ms")).agg(F.max_by("close", "open_time_ms").alias("price"))
    w = Window.partitionBy("symbol").orderBy(f"{name}_ms")
    slow = F.when(F.count("*").over(w.rowsBetween(-3, 0)) == 4, F.avg("price").over(w.rowsBetween(-3, 0)))
    return x.withColumns({"fast": F.avg("price").over(w.rowsBetween(-1, 0)), "slow": slow})


def _context_sql(days: int, name: str) -> str:
    step = days * DAY_MS
    return f"""{name}_bars as (select symbol, open_time_ms - open_time_ms % {step} + {step - 1} as {name}_ms, arg_max(close, open_time_ms) as price from candles group by 1, 2),
 {name} as (select symbol, {name}_ms, price as {name}_price, avg(price) over (partition by symbol order by {name}_ms rows between 1 preceding and current row) as {name}_fast, case when count(*) over k = 4 then avg(price) over k end as {name}_slow from {name}_bars window k as (partition by symbol order by {name}_ms rows between 3 preceding and current row))"""


_CONTEXTS = f"""{candles_sql()}, {_context_sql(7, 'near')}, {_context_sql(30, 'far')}, x as (select c.symbol, open_time_ms, close > open as long, case when trade_count % 10 = 0 then 0 else 50 + trade_count % 50 end as score, near_price, near_fast, near_slow, far_price, far_fast, far_slow
 from candles c asof left join near on c.symbol = near.symbol and c.close_time_ms > near.near_ms asof left join far on c.symbol = far.symbol and c.close_time_ms > far.far_ms)"""


def _contexts(spark, d) -> DataFrame:
    bars = candles(spark, d)
    x = bars
    for days, name in ((7, "near"), (30, "far")):
        x = joins.asof(x, _context(bars, days, name), ["symbol"], "close_time_ms", f"{name}_ms").withColumnRenamed("matched", name)
    n = F.col("trade_count")
    return x.select("symbol", "open_time_ms", "near", "far", (F.col("close") > F.col("open")).alias("long"), F.when(n % 10 == 0, 0).otherwise(50 + n % 50).alias("score"))


@_register("r06_context_score", f"with {_CONTEXTS} select symbol, open_time_ms, case when score = 0 then score else greatest(0, least(100, score + case when case when long then near_fast > near_slow else near_fast < near_slow end then 5 else 0 end + case when case when long then far_price > far_fast else far_price < far_fast end then 5 else 0 end - case when case when long then far_price < far_fast and far_fast < far_slow else far_price > far_fast and far_fast > far_slow end then 10 else 0 end)) end as score from x")
def r06(spark, d):
    x = _contexts(spark, d)
    return x.select("symbol", "open_time_ms", gates.context_adjusted(F.col("score"), F.col("long"), "near", "far").alias("score"))


_ALIGNED = lambda n: f"case when {n}_slow is null then 'missing {n}' when not case when long then {n}_price > {n}_fast and {n}_fast > {n}_slow else {n}_price < {n}_fast and {n}_fast < {n}_slow end then '{n} not aligned' end"


@_register("r08_alignment", f"with {_CONTEXTS} select symbol, open_time_ms, concat_ws('; ', {_ALIGNED('near')}, {_ALIGNED('far')}) as failures from x")
def r08(spark, d):
    x = _contexts(spark, d)
    return x.select("symbol", "open_time_ms", F.array_join(gates.alignment_failures(F.col("long"), {"near": "near", "far": "far"}), "; ").alias("failures"))


@_register("r11_entry_pick", "with x as (select l_returnflag as symbol, epoch_ms(cast(l_shipdate as timestamp)) as slot_ms, cast(l_quantity as bigint) as score, l_linestatus as family, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as id from lineitem), k as (select *, row_number() over (partition by symbol, slot_ms order by score desc, family, id) as k from x) select symbol, slot_ms, score, family, id from k where k = 1")
def r11(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), epoch_ms("l_shipdate").alias("slot_ms"), F.col("l_quantity").cast("long").alias("score"), F.col("l_linestatus").alias("family"), ((F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("id"))
    return gates.entry_pick(x, ["symbol", "slot_ms"], "score", "family", "id")


@_register("r12_first_setups", "with x as (select user_id, event_id, ts, case when event_id % 11 = 0 then 'INVALIDATED' when event_id % 3 = 0 then 'SETUP' else 'WATCH' end as stage from events), e as (select *, count(*) filter (stage = 'INVALIDATED') over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as episode from x), k as (select *, row_number() over (partition by user_id, episode order by ts, event_id) as k from e where stage = 'SETUP') select user_id, episode, event_id from k where k = 1")
def r12(spark, d):
    stage = F.when(F.col("event_id") % 11 == 0, "INVALIDATED").when(F.col("event_id") % 3 == 0, "SETUP").otherwise("WATCH")
    x = table(spark, d, "events").select("user_id", "event_id", "ts", stage.alias("stage"))
    return gates.first_of_episodes(x, "user_id", ["ts", "event_id"], F.col("stage") == "INVALIDATED", F.col("stage") == "SETUP").select("user_id", "episode", "event_id")


_PANELS = list(product(("A", "N", "Q", "R"), (1, -1)))


@_register("a03_panels", f"with {_BREAKS}, sums as (select symbol, direction, count(*) as n, avg(net_return) as mean_net from z group by 1, 2), panels(symbol, direction) as (values {', '.join(f'''('{s}', {x})''' for s, x in _PANELS)}) select panels.symbol, panels.direction, coalesce(n, 0) as n, {r('mean_net')} as mean_net from panels left join sums on panels.symbol = sums.symbol and panels.direction = sums.direction")
def a03(spark, d):
    panels = spark.createDataFrame(_PANELS, "symbol string, direction int")
    s = _breaks(spark, d).groupBy("symbol", "direction").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean_net"))
    return rounded(gates.on_panels(s, panels, ["symbol", "direction"], ["n"]))


@_register("a14_contributions", f"with {_BREAKS}, e as (select direction, symbol, sum(((mae > -0.02::double)::int - (mfe > 0.01::double)::int) * net_return) as s, count(*) as n from z group by 1, 2), c as (select direction, symbol, s / sum(n) over (partition by direction) as c from e) select direction, symbol, {r('c', 8)} as contribution, count(*) filter (c > 0) over k as positive_assets, {r('max(c) filter (c > 0) over k / sum(c) filter (c > 0) over k', 8)} as concentration from c window k as (partition by direction)")
def a14(spark, d):
    return rounded(gates.contributions(_breaks(spark, d), ["direction"], "symbol", "net_return", F.col("mfe") > 0.01, F.col("mae") > -0.02), 8)


@_register("a18_micros_summary", f"with {_BREAKS}, micros as (select symbol, direction, case when year % 4 <> 0 then cast(round(net_return * 1000000) as bigint) end as m from z), sums as (select symbol, direction, count(*) as population, count(m) as evaluable, count(*) - count(m) as missing, cast(coalesce(sum(m), 0) as bigint) as total, {r('avg(m)')} as mean, {r('median(m)')} as median, count(*) filter (m > 0) as hits, {r('count(*) filter (m > 0) / nullif(count(m), 0)')} as hit_rate, cast(coalesce(sum(m) filter (m > 0), 0) as bigint) as gross_profit, cast(coalesce(-sum(m) filter (m < 0), 0) as bigint) as gross_loss from micros group by 1, 2) select *, {r('gross_profit / nullif(gross_loss, 0)')} as profit_factor, case when gross_loss > 0 then 'FINITE' when gross_profit > 0 then 'POSITIVE_INFINITY_NO_LOSSES' else 'UNDEFINED_NO_PROFIT_OR_LOSS' end as status from sums")
def a18(spark, d):
    x = _breaks(spark, d).withColumn("micros", F.when(F.col("year") % 4 != 0, F.round(F.col("net_return") * 1000000).cast("long")))
    return rounded(x.groupBy("symbol", "direction").agg(*gates.micros_summary()))


_POLL_MS = 1_800_000


@_register("c14_due_polls", f"with {TICKS}, o as (select min(ts_ms) as t0, max(ts_ms) as t1 from ticks), p as (select symbol, (ts_ms - t0) // {_POLL_MS} as k, (t1 - t0) // {_POLL_MS} as due from ticks, o), d as (select distinct symbol, k from p where k between 1 and due), n as (select symbol, count(*) as completed from d group by 1), g as (select symbol, unnest(range(1, due + 1)) as k from (select symbol, max(due) as due from p group by 1)), h as (select symbol, min(k) as first_missing from g anti join d using (symbol, k) group by 1) select symbol, max(due) as due, coalesce(max(completed), 0) as completed, max(due) - coalesce(max(completed), 0) as missing, max(first_missing) as first_missing from p left join n using (symbol) left join h using (symbol) group by 1")
def c14(spark, d):
    x = ticks(spark, d)
    ends = x.agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"))
    x = x.join(F.broadcast(ends))  # one row
    number = lambda t: F.floor((F.col(t) - F.col("t0")) / _POLL_MS).cast("long")
    return gates.due_slots(x.select("symbol", number("ts_ms").alias("k"), number("t1").alias("due")), "symbol", "k", "due")
