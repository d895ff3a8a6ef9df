"""Registered queries of the live guards; feeds are events in order of receipt, with planted faults, in three parts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import shared_folder
from ..streaming import guards, streams
from .market import _register, r, rounded
from .views import DAY_MS, TICKS, candles, candles_sql, ticks

#: Feeds run two hundred times as fast as the events, from this time on.
START_MS, SPEED = 1_704_067_200_000, 200


#: Rows of a part of a feed, about: one part is one micro-batch, of which a guard holds the rows of a key.
ROWS = 2_000_000


def _parts(rows: DataFrame, column: str = "arrival", n: int = 3) -> list[DataFrame]:
    """At least ``n`` parts of about equal spans of ``column``, as many as keep them near ``ROWS`` rows; ``rows`` is read once for all."""
    low, high, count = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    n = max(n, -(-count // ROWS))
    part = F.least(F.floor((F.col(column) - low) * n / (high - low + 1)), F.lit(n - 1))
    place = f"{shared_folder(rows.sparkSession)}/parts-{uuid.uuid4().hex}"
    rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(place)
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])
    stored = rows.sparkSession.read.schema(schema).parquet(place)
    return [stored.where(F.col("_part") == i).drop("_part") for i in range(n)]


def _fed(rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return streams.fed([{"rows": p} for p in _parts(rows)], build)


# ---- intrabar anomalies ----
_TICKERS = f"""{TICKS}, feed0 as (select symbol, agg_id as arrival, agg_id, (ts_ms - {START_MS}) // {SPEED} as x from ticks where symbol <> 'error'),
feed1 as (select symbol, arrival, agg_id, {START_MS} + x - x % 2000 - case when agg_id % 37 = 0 then 20000 else 0 end as event_time_ms from feed0),
feed as (select symbol, arrival, event_time_ms, case when agg_id % 53 = 0 then 0 else 100 * (1 + (agg_id % 7) * 0.0001::double) * case when (event_time_ms // 60000) % 6 = 5 then 1.05::double else 1 end end as price from feed1)"""


def _tickers(spark: SparkSession, d: str) -> DataFrame:
    """Prices on a grid of two seconds; some come late, some have no price, some minutes stand five percent higher."""
    n = F.col("agg_id")
    x = ticks(spark, d).where("symbol <> 'error'").withColumn("x", F.floor((F.col("ts_ms") - START_MS) / SPEED).cast("long"))
    x = x.withColumn("event_time_ms", START_MS + F.expr("x - x % 2000") - F.when(n % 37 == 0, 20000).otherwise(0))
    lift = F.when(F.expr("(event_time_ms div 60000) % 6 = 5"), 1.05).otherwise(1.0)
    price = F.when(n % 53 == 0, 0.0).otherwise(100 * (1 + (n % 7) * 0.0001) * lift)
    return x.select("symbol", n.alias("arrival"), "event_time_ms", price.alias("price"))


@_register(
    "t03_intrabar_anomalies",
    f"""with {_TICKERS}, valid as (select *, max(event_time_ms) over (partition by symbol order by arrival rows between unbounded preceding and 1 preceding) as top from feed where price > 0),
 taken as (select *, dense_rank() over (partition by symbol order by event_time_ms) as k from valid where top is null or event_time_ms >= top),
 final as (select symbol, k, event_time_ms as t, price from taken qualify row_number() over (partition by symbol, event_time_ms order by arrival desc) = 1),
 points as (select a.symbol, a.arrival, a.event_time_ms as now, a.price as last, f.k, f.t, f.price from taken a join final f on f.symbol = a.symbol and f.k between a.k - 599 and a.k - 1 and f.t >= a.event_time_ms - 600000
  union all select symbol, arrival, event_time_ms, price, k, event_time_ms, price from taken),
 held as (select symbol, arrival, now, last, count(*) as n, list(price order by k) as p, arg_min(price, (abs(t - now + 30000), k)) as anchor, arg_min(t, (abs(t - now + 30000), k)) as anchor_t from points group by 1, 2, 3, 4),
 steps as (select *, last / anchor - 1 as change, list_transform(range(2, n + 1), lambda i: ln(p[i] / p[i - 1])) as s from held),
 medians as (select *, list_aggregate(s, 'quantile_cont', 0.5) as m from steps),
 scored as (select *, abs(ln(last / anchor)) / (greatest(1.4826 * list_aggregate(list_transform(s, lambda v: abs(v - m)), 'quantile_cont', 0.5), 1e-9) * sqrt(30)) as z from medians),
 judged as (select *, n >= 20 and anchor_t <= now - 25000 and abs(change) >= 0.015 and z >= 4 as hit from scored)
select symbol, arrival, now as event_time_ms, {r('last')} as price, family, case when family = 'PUMP_RISK' then 'RISK_UP' else 'RISK_DOWN' end as direction,
 case when on_side then cast(least(100, floor(70 + least(15, z - 4) + least(15, abs(change) * 500))) as bigint) else 0 end as score, on_side as triggered, case when on_side then {r('change')} end as change, case when on_side then {r('z', 3)} end as robust_zscore
from (select *, coalesce(hit and (change > 0) = (family = 'PUMP_RISK'), false) as on_side from judged, (values ('PUMP_RISK'), ('CRASH_RISK')) v(family))""",
)
def t03(spark, d):
    x = _fed(_tickers(spark, d), lambda rows: guards.anomalies(rows))
    return rounded(x.withColumn("robust_zscore", F.round("robust_zscore", 3)))


# ---- late and open bars ----
_BAR_FEED = f"""{candles_sql()}, ranked as (select symbol, open_time_ms, close, row_number() over (order by open_time_ms, symbol) as n from candles),
feed as (select symbol, open_time_ms, close, n % 9 <> 0 as is_closed, n * 10 as arrival from ranked union all select symbol, open_time_ms, close, true, n * 10 + 3 from ranked where n % 5 = 0
 union all select symbol, open_time_ms, close + 1, true, n * 10 + 5 from ranked where n % 7 = 0 union all select symbol, open_time_ms, close, true, n * 10 + 75 from ranked where n % 11 = 0)"""


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Bars numbered by time and symbol, as they would be received; ranks of days and of the symbols of a day."""
    x = candles(spark, d).select("symbol", "open_time_ms", "close")
    days = x.groupBy("open_time_ms").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))
    return x.join(_running(days), "open_time_ms").withColumn("n", F.col("before") + F.array_position("symbols", F.col("symbol"))).drop("before", "symbols")


def _running(days: DataFrame) -> DataFrame:
    """``before``: symbols of earlier days, as running sums inside months added to those of earlier months."""
    x = days.withColumn("month", F.floor(F.col("open_time_ms") / (30 * DAY_MS))).withColumn("c", F.size("symbols").cast("long"))
    months = x.groupBy("month").agg(F.sum("c").alias("c"))
    past = months.withColumn("past", F.coalesce(F.sum("c").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    inside = F.sum("c").over(Window.partitionBy("month").orderBy("open_time_ms")) - F.col("c")
    return x.withColumn("inside", inside).join(past, "month").select("open_time_ms", "symbols", (F.col("past") + F.col("inside")).alias("before"))


def _bar_feed(spark: SparkSession, d: str) -> DataFrame:
    """Bars in order of receipt, some not closed, repeated at once, corrected, or repeated two days late."""
    n = F.col("n")
    copies = [F.struct(n * 10, F.col("close"), n % 9 != 0)]
    copies += [F.when(n % k == 0, F.struct(n * 10 + late, F.col("close") + more, F.lit(True))) for k, late, more in ((5, 3, 0), (7, 5, 1), (11, 75, 0))]
    x = _numbered(spark, d).select("symbol", "open_time_ms", F.explode(F.array_compact(F.array(*(c.cast("struct<arrival: long, close: double, is_closed: boolean>") for c in copies)))).alias("x"))
    return x.select("symbol", "open_time_ms", "x.*")


@_register(
    "t02_late_bars",
    f"""with {_BAR_FEED}, topped as (select *, max(case when is_closed then open_time_ms end) over (partition by symbol order by arrival rows between unbounded preceding and 1 preceding) as top from feed),
 kept as (select *, row_number() over w as again, lag(close) over w as before from topped where is_closed and (top is null or open_time_ms >= top) window w as (partition by symbol, open_time_ms order by arrival))
select symbol, arrival, open_time_ms, {r('close')} as close, case when again = 1 then 'new' when close = before then 'repeat' else 'corrected' end as status from kept
union all select symbol, arrival, open_time_ms, {r('close')}, case when is_closed then 'late' else 'open' end from topped where not is_closed or open_time_ms < top""",
)
def t02(spark, d):
    return rounded(_fed(_bar_feed(spark, d), lambda rows: guards.bar_admission(rows, 60 * DAY_MS, "30 days")))


# ---- latest quote ----
_QUOTES = f"""{TICKS}, feed as (select symbol, ts_ms as event_time_ms, agg_id as arrival, agg_id // 20 - case when agg_id % 17 = 0 then 5 else 0 end as cursor, cast(100 + (agg_id // 3) % 2 as double) as bid, cast(102 as double) as ask from ticks)"""


@_register(
    "t07_latest_quotes",
    f"""with {_QUOTES}, topped as (select *, max(cursor) over (partition by symbol order by arrival rows between unbounded preceding and 1 preceding) as top, first_value(bid) over (partition by symbol, cursor order by arrival) as first_bid from feed)
select symbol, arrival, cursor, bid, ask, case when top is null or cursor > top then 'new' when cursor < top then 'stale' when bid = first_bid then 'repeat' else 'conflict' end as status from topped""",
)
def t07(spark, d):
    n = F.col("agg_id")
    cursor = F.floor(n / 20) - F.when(n % 17 == 0, 5).otherwise(0)
    x = ticks(spark, d).select("symbol", F.col("ts_ms").alias("event_time_ms"), n.alias("arrival"), cursor.alias("cursor"), (100 + F.floor(n / 3) % 2).cast("double").alias("bid"), F.lit(102.0).alias("ask"))
    return _fed(x, lambda rows: guards.latest_quotes(rows, 60 * DAY_MS, "30 days"))


# ---- bars held behind gaps ----
_GAPS = f"""{candles_sql()}, seqs as (select symbol, open_time_ms, close, row_number() over (partition by symbol order by open_time_ms) as rn, open_time_ms - min(open_time_ms) over (partition by symbol) as since from candles),
kept as (select symbol, open_time_ms, close, since // {DAY_MS} as day from seqs where since < 600::bigint * {DAY_MS}),
feed as (select symbol, open_time_ms, close, day * 10 as arrival, false as is_recovered from kept where day % 13 not in (5, 6) union all select symbol, open_time_ms, close + 0.5::double, (day - day % 13 + 13) * 10 + 5, true from kept where day % 13 in (5, 6) and day % 130 < 126
 union all select symbol, open_time_ms, close + 9, (day - day % 13 + 13) * 10 + 6, true from kept where day % 13 = 7)"""


@_register(
    "t09_gap_hold",
    f"""with {_GAPS}, firsts as (select symbol, open_time_ms, arrival, close, is_recovered from feed qualify row_number() over (partition by symbol, open_time_ms order by arrival) = 1),
 run as (select *, row_number() over w as place, min(open_time_ms) over (partition by symbol) as first_ms, max(arrival) over w as released_by from firsts window w as (partition by symbol order by open_time_ms))
select symbol, place, open_time_ms, {r('close')} as close, is_recovered, released_by from run where open_time_ms = first_ms + (place - 1) * {DAY_MS}""",
)
def t09(spark, d):
    x = candles(spark, d).select("symbol", "open_time_ms", "close")
    first = x.groupBy("symbol").agg(F.min("open_time_ms").alias("first"))
    x = x.join(first, "symbol").withColumn("day", F.expr(f"(open_time_ms - first) div {DAY_MS}L")).where("day < 600")
    live = x.where("day % 13 not in (5, 6)").select("symbol", "open_time_ms", "close", (F.col("day") * 10).alias("arrival"))
    after = (F.col("day") - F.col("day") % 13 + 13) * 10
    back = x.where("day % 13 in (5, 6) and day % 130 < 126").select("symbol", "open_time_ms", (F.col("close") + 0.5).alias("close"), (after + 5).alias("arrival"))
    again = x.where("day % 13 = 7").select("symbol", "open_time_ms", (F.col("close") + 9).alias("close"), (after + 6).alias("arrival"))
    recovered = back.unionByName(again)
    bounds = [(0, 2000), (2000, 4000), (4000, 10**9)]
    parts = [{"live": live.where(F.col("arrival").between(a, b - 1)), "recovered": recovered.where(F.col("arrival").between(a, b - 1))} for a, b in bounds]
    return rounded(streams.fed(parts, lambda live, recovered: guards.gap_hold(live, recovered, DAY_MS, 1000 * DAY_MS, "900 days")))


# ---- sliding flow and repeats ----
_FAST = f"fast as (select *, ({START_MS} + (ts_ms - {START_MS}) // {SPEED}) as fast_ms from ticks)"


@_register(
    "t05_sliding_flow",
    f"""with {TICKS}, {_FAST}, w as (select symbol, agg_id, fast_ms - fast_ms % 5000 - k * 5000 as start_ms from fast, range(12) as ks(k)), mark as (select max(fast_ms) - 10000 as mark from fast)
select symbol, start_ms, cast(sum(case when agg_id % 2 = 0 then -1 else 1 end) as bigint) as signed, count(*) as n from w, mark where start_ms + 60000 <= mark group by 1, 2""",
)
def t05(spark, d):
    ms = F.floor((F.unix_millis("ts") - START_MS) / SPEED) + START_MS
    events = streams.file_stream(spark, d, "events").withColumn("ts", F.timestamp_millis(ms))
    return streams.replayed(streams.sliding_flow(events)).select("symbol", F.unix_millis("start").alias("start_ms"), "signed", "n")


@_register(
    "t08_stream_dedup_repeats",
    """with e as (select event_id, event_type, epoch_ms(cast(ts as timestamp)) as ms from events), p as (select *, least(2, floor((ms - min(ms) over ()) * 3 / (max(ms) over () - min(ms) over () + 1))) as part, max(ms) over () - min(ms) over () as span from e)
select event_type, count(*) + count(*) filter (event_id % 5 = 0 and part = 0) as n from p group by 1""",
)
def t08_repeats(spark, d):
    """A third of the events twice at once, a third again in the next part, and a fifth of the first part anew in the last, long after their state expired."""
    e = ticks(spark, d).select(F.col("agg_id").alias("event_id"), F.col("symbol").alias("event_type"), F.col("ts_ms").alias("ms"))
    low, high = e.agg(F.min("ms"), F.max("ms")).first()
    first, second, third = _parts(e, "ms")
    # sent anew with a later time
    anew = first.where("event_id % 5 = 0").withColumn("ms", F.lit(high))
    timed = lambda x: x.select("event_id", "event_type", F.timestamp_millis("ms").alias("ts"))
    twice = lambda x: x.unionByName(x.where("event_id % 3 = 0"))
    parts = [twice(first), twice(second).unionByName(first.where("event_id % 3 = 1")), twice(third).unionByName(second.where("event_id % 3 = 1")).unionByName(anew)]
    delay = f"{max((high - low) // 100, 1)} milliseconds"
    x = streams.fed([{"rows": timed(p)} for p in parts], lambda rows: streams.unique_trades(rows, delay))
    return x.groupBy("event_type").agg(F.count("*").alias("n"))
