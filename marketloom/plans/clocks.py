"""Registered queries of two-clock selection, clipped book windows, derived bars and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clean, clocks
from .live import SPEED, START_MS
from .market import _register, r, rounded
from .views import HOUR_MS, PRINTS, TICKS, prints, ticks

# ---- observations with an event and a receipt clock: some are received late, some identities come twice with other values ----
_LATE = "case when agg_id % 9 = 0 then 5400000 when agg_id % 4 = 0 then 240000 else 800 end"
_CLOCKED = f"""{TICKS}, obs as (select symbol, ts_ms as event_ms, ts_ms + {_LATE} as receipt_ms, agg_id as seq, price from ticks union all select symbol, ts_ms, ts_ms + {_LATE}, agg_id, price + agg_id % 2 from ticks where agg_id % 23 = 0),
 decisions as (select distinct symbol, ts_ms - ts_ms % {HOUR_MS} + {HOUR_MS} as cutoff_ms, ts_ms - ts_ms % {HOUR_MS} + {HOUR_MS} + 60000 as deadline_ms from ticks)"""


@_register(
    "j07_two_clocks",
    f"""with {_CLOCKED}, joined as (select d.*, o.event_ms, o.receipt_ms, o.seq, o.price from decisions d left join obs o on o.symbol = d.symbol and o.event_ms between d.cutoff_ms - 1800000 and d.cutoff_ms and o.receipt_ms <= d.deadline_ms),
 ids as (select symbol, cutoff_ms, deadline_ms, event_ms, receipt_ms, seq, count(event_ms) as n, min(price) as price, min(price) <> max(price) as clash from joined group by 1, 2, 3, 4, 5, 6)
select symbol, cutoff_ms, deadline_ms, arg_max(event_ms, (event_ms, receipt_ms, seq)) as event_ms, arg_max(receipt_ms, (event_ms, receipt_ms, seq)) as receipt_ms, arg_max(seq, (event_ms, receipt_ms, seq)) as seq, {r('arg_max(price, (event_ms, receipt_ms, seq))')} as price,
 cast(sum(n) as bigint) as n_candidates, count(*) filter (clash) as n_conflicts from ids group by 1, 2, 3""",
)
def j07(spark, d):
    t, n = ticks(spark, d), F.col("agg_id")
    late = F.when(n % 9 == 0, 5_400_000).when(n % 4 == 0, 240_000).otherwise(800)
    obs = t.select("symbol", F.col("ts_ms").alias("event_ms"), (F.col("ts_ms") + late).alias("receipt_ms"), n.alias("seq"), "price")
    obs = obs.unionByName(obs.where("seq % 23 = 0").withColumn("price", F.col("price") + F.col("seq") % 2))
    cutoff = F.expr(f"ts_ms - ts_ms % {HOUR_MS}L + {HOUR_MS}L")
    asked = t.select("symbol", cutoff.alias("cutoff_ms"), (cutoff + 60_000).alias("deadline_ms")).distinct()
    return rounded(clocks.two_clock_latest(asked, obs, ["symbol"], "cutoff_ms", "deadline_ms", "event_ms", "receipt_ms", "seq", ["price"], 1_800_000))


# ---- book states on the fast feed, clipped to windows of five-minute bars ----
_BOOK = f"""{TICKS}, fast as (select *, {START_MS} + (ts_ms - {START_MS}) // {SPEED} as fast_ms from ticks),
 states as (select symbol, fast_ms as start_ms, max(agg_id) as seq from fast group by 1, 2),
 valued as (select s.symbol, s.start_ms, t.price as mid, cast(1 + agg_id % 9 as double) as spread_bps, cast(100 + agg_id % 31 as double) as bid_depth, cast(100 + agg_id % 37 as double) as ask_depth, lead(s.start_ms) over (partition by s.symbol order by s.start_ms) as next_ms from states s join ticks t on t.agg_id = s.seq),
 stood as (select *, least(coalesce(next_ms, start_ms + 60000), start_ms + 60000) as end_ms from valued),
 cut as (select *, unnest(range(start_ms // 300000, (end_ms - 1) // 300000 + 1)) * 300000 as open_ms from stood),
 windows as (select * from (values ('first_5s', 0, 5000), ('last_5s', 295000, 5000), ('first_30s', 0, 30000), ('last_30s', 270000, 30000), ('full', 0, 300000)) w("window", lo, expected_ms)),
 pieces as (select symbol, open_ms, "window", expected_ms, least(end_ms, open_ms + lo + expected_ms) - greatest(start_ms, open_ms + lo) as duration_ms, mid, spread_bps, bid_depth, ask_depth from cut, windows where least(end_ms, open_ms + lo + expected_ms) > greatest(start_ms, open_ms + lo))"""
_QUANTILE = "select {by}, min({v}) as q from (select {by}, {v}, sum(sum(duration_ms)) over (partition by {by} order by {v}) as upto, sum(sum(duration_ms)) over (partition by {by}) as whole from {t} group by {by}, {v}) where upto >= whole * {q}::double group by {by}"


def _states(spark, d):
    n = F.col("agg_id")
    fast = (F.floor((F.col("ts_ms") - START_MS) / SPEED) + START_MS).cast("long")
    return ticks(spark, d).select("symbol", fast.alias("ts_ms"), n.alias("seq"), F.col("price").alias("mid"), (1 + n % 9).cast("double").alias("spread_bps"), (100 + n % 31).cast("double").alias("bid_depth"), (100 + n % 37).cast("double").alias("ask_depth"), "price", "qty", "is_buyer_maker")


@_register(
    "w41_book_windows",
    f"""with {_BOOK}, sums as (select symbol, open_ms, "window", max(expected_ms)::bigint as expected_ms, sum(duration_ms)::bigint as duration_ms, count(*) as n_pieces, max(spread_bps) as widest, {r('sum(mid * duration_ms) / sum(duration_ms)', 4)} as mean_mid from pieces group by 1, 2, 3),
 q as ({_QUANTILE.format(by='symbol, open_ms, "window"', v='mid', q='0.5', t='pieces')}) select s.*, duration_ms = expected_ms as covered, {r('q')} as median_mid from sums s join q using (symbol, open_ms, "window")""",
)
def w41(spark, d):
    pieces = clocks.book_windows(_states(spark, d), ["symbol"], "ts_ms", "seq", ["mid", "spread_bps"], max_age_ms=60_000)
    by = ["symbol", "open_ms", "window"]
    mean = F.round(F.sum(F.col("mid") * F.col("duration_ms")) / F.sum("duration_ms"), 4)
    sums = pieces.groupBy(*by).agg(F.max("expected_ms").alias("expected_ms"), F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("n_pieces"), F.max("spread_bps").alias("widest"), mean.alias("mean_mid"))
    sums = sums.withColumn("covered", F.col("duration_ms") == F.col("expected_ms"))
    return rounded(sums.join(clocks.weighted_quantile(pieces, by, "mid", "duration_ms", 0.5).withColumnRenamed("quantile", "median_mid"), by))


_PRIOR = 12
_RZ = "case when len(past) = {n} and mad > 0 then ({c} - med) / (1.4826 * mad) end"


def _z_sql(table: str, c: str, out: str) -> str:
    past = f"select symbol, open_ms, {c}, list({c}) over (partition by symbol order by open_ms rows between {_PRIOR} preceding and 1 preceding) as past from {table} where {c} is not null"
    med = f"select *, list_aggregate(past, 'quantile_cont', 0.5) as med from ({past})"
    mad = f"select *, list_aggregate(list_transform(past, lambda v: abs(v - med)), 'quantile_cont', 0.5) as mad from ({med})"
    return f"select symbol, open_ms, {_RZ.format(n=_PRIOR, c=c)} as {out} from ({mad})"


@_register(
    "w44_liquidity_bars",
    f"""with {_BOOK}, flow as (select symbol, fast_ms - fast_ms % 300000 as open_ms, count(*) as n_trades, sum(case when is_buyer_maker then -price * qty else price * qty end) as signed_notional, sum(price * qty) as notional from fast group by 1, 2),
 faced as (select p.*, case when signed_notional > 0 then ask_depth when signed_notional < 0 then bid_depth else 0 end as facing from pieces p left join flow f using (symbol, open_ms)),
 covered as (select symbol, open_ms from pieces group by 1, 2 having sum(duration_ms) = 370000),
 {', '.join(f"q_{n} as ({_QUANTILE.format(by='symbol, open_ms', v=v, q=q, t='(select * from faced where ' + chr(34) + 'window' + chr(34) + f' = {chr(39)}{w}{chr(39)})')})" for n, w, v, q in (('first_mid', 'first_5s', 'mid', 0.5), ('last_mid', 'last_5s', 'mid', 0.5), ('d_start', 'first_30s', 'facing', 0.5), ('d_low', 'full', 'facing', 0.05), ('d_end', 'last_30s', 'facing', 0.5), ('spread95', 'full', 'spread_bps', 0.95)))},
 bars as (select c.symbol, c.open_ms, coalesce(n_trades, 0) as n_trades, signed_notional, notional, signed_notional / notional as flow_imbalance, ln(b.q / a.q) as bar_return, s.q as d_start, l.q as d_low, e.q as d_end, w.q as spread95 from covered c join q_first_mid a using (symbol, open_ms) join q_last_mid b using (symbol, open_ms)
  join q_d_start s using (symbol, open_ms) join q_d_low l using (symbol, open_ms) join q_d_end e using (symbol, open_ms) join q_spread95 w using (symbol, open_ms) left join flow f using (symbol, open_ms)),
 zf as ({_z_sql('bars', 'flow_imbalance', 'flow_imbalance_rz')}), zr as ({_z_sql('bars', 'bar_return', 'bar_return_rz')})
select symbol, open_ms, n_trades, {r('signed_notional', 4)} as signed_notional, {r('notional', 4)} as notional, {r('flow_imbalance')} as flow_imbalance, {r('bar_return')} as bar_return, d_start, d_low, d_end, spread95, {r('flow_imbalance_rz', 4)} as flow_imbalance_rz, {r('bar_return_rz', 4)} as bar_return_rz
 from bars left join zf using (symbol, open_ms) left join zr using (symbol, open_ms)""",
)
def w44(spark, d):
    # a dozen prior bars for 8,640, which the tables do not have
    x = clocks.liquidity_bars(_states(spark, d), _states(spark, d), _PRIOR, max_age_ms=60_000)
    return rounded(x.withColumns({c: F.round(c, 4) for c in ("signed_notional", "notional", "flow_imbalance_rz", "bar_return_rz")}))


# ---- derived bars: twelve five-minute bars of the fast feed make an hour, held against hours from the trades ----
_HOURS = "first(price order by agg_id) as open, max(price) as high, min(price) as low, last(price order by agg_id) as close, sum(cast(qty as decimal(38, 18))) as volume, sum(cast(price as decimal(18, 4)) * cast(qty as decimal(18, 4))) as quote_volume, count(*) as trade_count"


def _bars_of(fast, ms: int):
    price, qty = F.col("price").cast("decimal(18,4)"), F.col("qty").cast("decimal(18,4)")
    return fast.groupBy("symbol", F.expr(f"ts_ms - pmod(ts_ms, {ms}L)").alias("open_time_ms")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum(qty).cast("decimal(38,18)").alias("volume"), F.sum(price * qty).cast("decimal(38,18)").alias("quote_volume"), F.count("*").alias("trade_count"),
    )


@_register(
    "p07_derived_hours",
    f"""with {TICKS}, fast as (select *, {START_MS} + (ts_ms - {START_MS}) // {SPEED} as fast_ms from ticks), parts as (select symbol, fast_ms - fast_ms % 300000 as open_ms, {_HOURS} from fast group by 1, 2),
 kept as (select * from parts where not (symbol = 'view' and open_ms % 2100000 = 0)), native as (select symbol, fast_ms - fast_ms % 3600000 as open_ms, {_HOURS} from fast group by 1, 2),
 whole as (select symbol, open_ms - open_ms % 3600000 as open_ms, first(open order by open_ms) as open, max(high) as high, min(low) as low, last(close order by open_ms) as close, sum(volume) as volume, sum(quote_volume) as quote_volume, cast(sum(trade_count) as bigint) as trade_count, count(*) as n_parts from kept group by 1, 2)
select w.symbol, w.open_ms as open_time_ms, w.open, w.high, w.low, w.close, cast(w.volume as double) as volume, cast(w.quote_volume as double) as quote_volume, w.trade_count, n_parts,
 case when n_parts < 12 then 'incomplete' when w.symbol = 'error' then 'unmatched' when w.symbol = 'signup' then 'close' when w.symbol = 'purchase' then 'volume' else 'ready' end as status from whole w join native n using (symbol, open_ms)""",
)
def p07(spark, d):
    """Parts of one symbol are taken out; natives of others are taken out, or moved by a price tick or by far less than a double of the sum would show."""
    fast = _states(spark, d)
    parts = _bars_of(fast, 300_000).where("not (symbol = 'view' and open_time_ms % 2100000 = 0)")
    natives = _bars_of(fast, 3_600_000).where("symbol <> 'error'")
    natives = natives.withColumn("close", F.when(F.col("symbol") == "signup", F.col("close") + 0.01).otherwise(F.col("close")))
    last_digit = F.lit("0.0000000000001").cast("decimal(38,18)")
    natives = natives.withColumn("quote_volume", F.when(F.col("symbol") == "purchase", (F.col("quote_volume") + last_digit).cast("decimal(38,18)")).otherwise(F.col("quote_volume")))
    x = clean.derived_bars(parts, natives, 300_000, 3_600_000)
    return x.withColumns({c: F.col(c).cast("double") for c in ("volume", "quote_volume")})


# ---- labels, ids and strengths ----
@_register(
    "f06_labels",
    f"""with {PRINTS}, x as (select *, (drift - 5) / 1000.0::double as long_net, (4 - drift) / 1000.0::double as short_net from prints)
select case when long_net > 0.002::double and long_net > short_net then 'LONG' when short_net > 0.002::double and short_net > long_net then 'SHORT' else 'FLAT' end as label, count(*) as n, count(distinct substr(sha256(concat_ws('|', symbol, ts_ms, drift)), 1, 24)) as ids, min(substr(sha256(concat_ws('|', symbol, ts_ms, drift)), 1, 24)) as first_id,
 cast(sum(floor(1e6::double * abs(long_net) / (1 + abs(long_net)) * (spread / 8.0::double) + 1e-7::double)) as bigint) as strength from x group by 1""",
)
def f06(spark, d):
    x = prints(spark, d).withColumns({"long_net": (F.col("drift") - 5) / 1000.0, "short_net": (4 - F.col("drift")) / 1000.0})
    # the strengths are of few values; a hair above each keeps engines from rounding a whole one down
    value = F.abs("long_net") / (1 + F.abs("long_net"))
    strength = scalars.squash(F.col("long_net"), F.col("spread") / 8.0)
    hair = F.when(F.floor(F.lit(1e6) * value * (F.col("spread") / 8.0) + 1e-7) > strength, 1).otherwise(0)
    ident = scalars.decision_id(F.col("symbol"), F.col("ts_ms").cast("string"), F.col("drift").cast("string"))
    x = x.select(scalars.outcome_label(F.col("long_net"), F.col("short_net"), 0.002).alias("label"), ident.alias("id"), (strength + hair).alias("s"))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.sum("s").alias("strength"))
