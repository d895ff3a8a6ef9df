"""Registered market queries and their SQL: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clean, coverage, inference, joins, kernels, metrics, rules, series, walkforward
from ..sources import decode
from ..streaming import streams
from .views import DAY_MS, FUNDING, HOUR_MS, PRINTS, TICKS, candles, candles_sql, epoch_ms, funding, prints, table, ticks

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        _queries[name] = function
        if sql:
            _oracles[name] = sql
        return function

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits (and no negative zero), for comparison across engines."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::double"


# ---- sources ----
def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as wrapped JSON trade messages, some of them broken."""
    e = ticks(spark, d)
    body = F.to_json(F.struct(F.when(F.col("agg_id") % 50 != 0, F.lit("aggTrade")).otherwise("other").alias("e"), F.col("symbol").alias("s"), F.when(F.col("agg_id") % 70 != 0, F.format_string("%.4f", "price")).otherwise("x").alias("p"), F.format_string("%.1f", "qty").alias("q"), F.col("agg_id").alias("a"), F.col("ts_ms").alias("T"), F.col("is_buyer_maker").alias("m")))
    return e.select(F.concat(F.lit('{"payload":{"stream":"x","data":'), body, F.lit("}}")).alias("value"))


@_register("s04_json_decode", f"with {TICKS} select symbol, count(*) as n, count(*) filter (agg_id % 50 = 0 or agg_id % 70 = 0) as rejected, {r('sum(case when agg_id % 50 = 0 or agg_id % 70 = 0 then 0 else price * qty end)', 2)} as notional from ticks group by symbol")
def s04(spark, d):
    x = decode.decode(_lines(spark, d))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejected"), (F.round(F.sum(F.when(~F.col("rejected"), F.col("price") * F.col("qty")).otherwise(F.lit(0.0))), 2) + F.lit(0.0)).alias("notional"))


def _bodies(c: DataFrame) -> DataFrame:
    """Symbol and REST body of each candle."""
    text = lambda x: F.col(x).cast("string")
    body = F.to_json(F.array(F.array(*(text(x) for x in ("open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms", "quote_volume", "trade_count", "taker_quote", "taker_quote")))))
    return c.select("symbol", body.alias("body"))


@_register("s06_positional_bars", f"with {candles_sql()} select open_time_ms, open, high, low, close, volume, close_time_ms, trade_count from candles where symbol = 'A'")
def s06(spark, d):
    return decode.positional_bars(_bodies(candles(spark, d).where("symbol = 'A'")))


@_register("s06_positional_bars_all", f"with {candles_sql()} select symbol, open_time_ms, open, high, low, close, volume, close_time_ms, trade_count from candles")
def s06_all(spark, d):
    return decode.positional_bars(_bodies(candles(spark, d)), ("symbol",))


@_register("s12_upsert", "with u as (select o_orderkey, o_totalprice, o_orderdate, 0 as v from orders union all select o_orderkey, o_totalprice + 1, o_orderdate, 1 from orders where o_orderkey % 3 = 0), k as (select *, row_number() over (partition by o_orderkey order by v desc) as n from u) select o_orderkey, o_totalprice, v from k where n = 1")
def s12(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("v"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("v"))
    return decode.upsert(old, new, ["o_orderkey"], "v")


@_register("s13_write_conflicts", "select l_orderkey, count(*) as n, count(distinct l_returnflag) as contents, case when count(distinct l_returnflag) > 1 then 'conflict' when count(*) > 1 then 'duplicate' else 'unique' end as status from lineitem group by 1")
def s13(spark, d):
    return decode.conflicts(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", ["l_returnflag"])


@_register("s14_recent", "select event_id, event_type, value from events order by ts desc, event_id desc limit 50")
def s14(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


# ---- cleaning ----
@_register("p01_bar_violations", f"with {candles_sql()} select symbol, count(*) as n, count(*) filter (high < greatest(open, close) or low > least(open, close) or taker_quote > quote_volume) as broken from candles group by symbol")
def p01(spark, d):
    return candles(spark, d).withColumn("v", clean.violations()).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.size("v") > 0).alias("broken"))


@_register("p03_latest_by_key", "with k as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey, l_extendedprice, l_quantity) as n from lineitem) select l_orderkey, l_linenumber, l_partkey, l_quantity from k where n = 1")
def p03(spark, d):
    x = clean.latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_quantity")])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_HOURS = f"{TICKS}, hours as (select symbol, ts_ms - ts_ms % {HOUR_MS} as open_time_ms, count(*) as n from ticks group by 1, 2)"


def _hours(spark, d):
    return ticks(spark, d).groupBy("symbol", F.expr(f"ts_ms - pmod(ts_ms, {HOUR_MS}L)").alias("open_time_ms")).agg(F.count("*").alias("n"))


@_register("p04_gaps", f"with {_HOURS}, g as (select symbol, lag(open_time_ms) over (partition by symbol order by open_time_ms) as after_ms, open_time_ms as before_ms from hours) select *, (before_ms - after_ms) // {HOUR_MS} - 1 as missing from g where before_ms - after_ms > {HOUR_MS}")
def p04(spark, d):
    return clean.gaps(_hours(spark, d), HOUR_MS)


@_register("p05_segments", f"with {_HOURS}, g as (select *, case when open_time_ms - lag(open_time_ms) over (partition by symbol order by open_time_ms) = {HOUR_MS} then 0 else 1 end as b from hours), s as (select *, cast(sum(b) over (partition by symbol order by open_time_ms) as bigint) as seg from g) select symbol, seg, count(*) as bars, min(open_time_ms) as first_ms, max(open_time_ms) as last_ms from s group by 1, 2")
def p05(spark, d):
    x = series.with_segments(_hours(spark, d), HOUR_MS)
    return x.groupBy("symbol", "seg").agg(F.count("*").alias("bars"), F.min("open_time_ms").alias("first_ms"), F.max("open_time_ms").alias("last_ms"))


@_register("p06_resample", f"with {candles_sql()}, b as (select symbol, open_time_ms - open_time_ms % {7 * DAY_MS} as bucket_ms, arg_min(open, open_time_ms) as open, max(high) as high, min(low) as low, arg_max(close, open_time_ms) as close, sum(volume) as volume, cast(sum(trade_count) as bigint) as trade_count, count(*) as n from candles group by 1, 2) select symbol, bucket_ms, open, high, low, close, {r('volume')} as volume, trade_count from b where n = 7")
def p06(spark, d):
    return rounded(clean.resample(candles(spark, d), DAY_MS, 7 * DAY_MS))


@_register("p08_quality_summary", f"with {_HOURS}, g as (select *, open_time_ms - lag(open_time_ms) over (partition by symbol order by open_time_ms) as g from hours) select symbol, count(*) as n_rows, min(open_time_ms) as first_ms, max(open_time_ms) as last_ms, count(*) filter (g > {HOUR_MS}) as gap_count, cast(coalesce(sum(case when g > {HOUR_MS} then g // {HOUR_MS} - 1 end), 0) as bigint) as missing from g group by symbol")
def p08(spark, d):
    return clean.quality_summary(_hours(spark, d), HOUR_MS)


@_register("p12_universe", "with v as (select n_regionkey, s_suppkey, s_acctbal, row_number() over (partition by n_regionkey order by s_acctbal desc, s_suppkey) as k from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0) select n_regionkey, s_suppkey, k from v where k <= 5")
def p12(spark, d):
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal > 0")
    w = series.Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return x.withColumn("k", F.row_number().over(w)).where("k <= 5").select("n_regionkey", "s_suppkey", "k")


# ---- series ----
_SEG = f"""{candles_sql()}, g as (select *, case when open_time_ms - lag(open_time_ms) over (partition by symbol order by open_time_ms) = {DAY_MS} then 0 else 1 end as b from candles),
s as (select *, cast(sum(b) over (partition by symbol order by open_time_ms) as bigint) as seg from g), n as (select *, row_number() over (partition by symbol, seg order by open_time_ms) as rn from s),
t as (select *, greatest(high - low, abs(high - lag(close) over k), abs(low - lag(close) over k)) as true_range, abs(close - lag(close) over k) as step from n window k as (partition by symbol, seg order by open_time_ms))"""


def _over(a: int, b: int) -> str:
    side = lambda x: "current row" if x == 0 else f"{abs(x)} {'preceding' if x < 0 else 'following'}"
    return f"over (partition by symbol, seg order by open_time_ms rows between {side(a)} and {side(b)})"


_Z = lambda c: f"case when count({c}) {_over(-30, -1)} >= 2 and stddev_pop({c}) {_over(-30, -1)} > 0 then ({c} - avg({c}) {_over(-30, -1)}) / stddev_pop({c}) {_over(-30, -1)} else 0 end"
_WIDTH = f"case when rn >= 20 and avg(close) {_over(-19, 0)} <> 0 then 4 * stddev_pop(close) {_over(-19, 0)} / abs(avg(close) {_over(-19, 0)}) end"
_W = {
    "recent_high": f"max(high) {_over(-20, -1)}", "recent_low": f"min(low) {_over(-20, -1)}", "relative_volume": f"case when avg(volume) {_over(-20, -1)} > 0 then volume / avg(volume) {_over(-20, -1)} else 1 end",
    "width": _WIDTH, "volume_zscore": _Z("volume"), "trade_count_zscore": _Z("trade_count"),
    "cvd_pressure": f"case when sum(quote_volume) {_over(-19, 0)} > 0 then greatest(-1, least(1, sum(2 * taker_quote - quote_volume) {_over(-19, 0)} / sum(quote_volume) {_over(-19, 0)})) else 0 end",
    "true_range": "true_range", "atr20": f"case when rn >= 20 then avg(true_range) {_over(-19, 0)} end",
    "vwma20": f"case when rn >= 20 then sum(close * quote_volume) {_over(-19, 0)} / sum(quote_volume) {_over(-19, 0)} end",
    "prior_median": f"case when rn > 12 then quantile_cont(close, 0.5) {_over(-12, -1)} end",
    "momentum": "ln(lag(close, 3) over (partition by symbol, seg order by open_time_ms) / lag(close, 24) over (partition by symbol, seg order by open_time_ms))",
    "support": f"case when rn > 36 then min(low) {_over(-36, -13)} end",
}


#: Added before rounding: ratios of round numbers may lie half way between two roundings.
_OFF_TIES = 1.7e-9


@_register("w_window_features", f"with {_SEG} select symbol, open_time_ms, {', '.join(f'round({v} + {_OFF_TIES}::double, 6) as {k}' for k, v in _W.items())} from t")
def w_window(spark, d):
    return rounded(series.window_features(candles(spark, d), DAY_MS).select("symbol", "open_time_ms", *((F.col(c) + _OFF_TIES).alias(c) for c in _W)))


@_register("w10_width_percentile", f"with {_SEG}, w as (select symbol, seg, open_time_ms, rn, round({_WIDTH}, 12) as width from t) select a.symbol, a.open_time_ms, {r('100.0::double * count(*) filter (b.width <= a.width) / count(b.width)', 4)} as width_percentile from w a join w b on a.symbol = b.symbol and a.seg = b.seg and b.rn between a.rn - 119 and a.rn where a.width is not null group by 1, 2")
def w10(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS).withColumn("width", F.round(series.bollinger_width(), 12))
    back = F.filter(F.collect_list("width").over(series.last(120)), lambda w: w <= F.col("width"))
    x = x.withColumn("width_percentile", 100.0 * F.size(back) / F.count("width").over(series.last(120)))
    return rounded(x.where("width is not null").select("symbol", "open_time_ms", "width_percentile"), 4)


@_register("w25_efficiency", f"with {_SEG} select symbol, open_time_ms, {r(f'case when rn > 20 then case when sum(step) {_over(-19, 0)} > 0 then abs(close - lag(close, 20) over (partition by symbol, seg order by open_time_ms)) / sum(step) {_over(-19, 0)} else 0 end end')} as efficiency from t")
def w25(spark, d):
    x = series.efficiency_ratio(series.with_segments(candles(spark, d), DAY_MS))
    return rounded(x.select("symbol", "open_time_ms", "efficiency"))


@_register("w21_pivots", f"with {_SEG}, p as (select symbol, open_time_ms, rn + 2 as known_rn, count(*) {_over(-2, -1)} = 2 and count(*) {_over(1, 2)} = 2 and high > max(high) {_over(-2, -1)} and high >= max(high) {_over(1, 2)} as pivot_high, count(*) {_over(-2, -1)} = 2 and count(*) {_over(1, 2)} = 2 and low < min(low) {_over(-2, -1)} and low <= min(low) {_over(1, 2)} as pivot_low from t) select symbol, open_time_ms, cast(known_rn as integer) as known_rn, pivot_high, pivot_low from p where pivot_high or pivot_low")
def w21(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS).withColumns(series.pivots())
    return x.where("pivot_high or pivot_low").select("symbol", "open_time_ms", "known_rn", "pivot_high", "pivot_low")


_RECURSIVE = f"""with recursive {_SEG}, seed as (select *, avg(close) {_over(-8, 0)} as s9, avg(close) {_over(-19, 0)} as s20, avg(true_range) {_over(-13, 0)} as sa from t),
e as (select symbol, seg, rn, cast(null as double) as ema9, cast(null as double) as ema20, cast(null as double) as atr from seed where rn = 1
 union all select s.symbol, s.seg, s.rn, case when s.rn = 9 then s.s9 when s.rn > 9 then e.ema9 + (s.close - e.ema9) * 0.2::double end, case when s.rn = 20 then s.s20 when s.rn > 20 then e.ema20 + (s.close - e.ema20) * (2.0::double / 21) end,
 case when s.rn = 14 then s.sa when s.rn > 14 then (e.atr * 13 + s.true_range) / 14 end from e join seed s on s.symbol = e.symbol and s.seg = e.seg and s.rn = e.rn + 1)
select e.symbol, t.open_time_ms, {r('ema9', 5)} as ema9, {r('ema20', 5)} as ema20, {r('atr', 5)} as atr from e join t on t.symbol = e.symbol and t.seg = e.seg and t.rn = e.rn"""


def _recursive(spark, d):
    return kernels.recursive_series(series.with_segments(candles(spark, d), DAY_MS).select("symbol", "seg", "open_time_ms", "open", "high", "low", "close", "volume", "quote_volume", "taker_quote", "trade_count"))


@_register("w01_smoothers", _RECURSIVE)
def w01(spark, d):
    return rounded(_recursive(spark, d).select("symbol", "open_time_ms", "ema9", "ema20", "atr"), 5)


_P = lambda n: f"(partition by symbol, seg order by rn rows between {n - 1} preceding and current row)"
_PREVIOUS = {"g": ("gain", 15, 14), "l": ("loss", 15, 14), "a": ("true_range", 14, 14), "p": ("plus", 14, 14), "m": ("minus", 14, 14)}
_EMAS = {f"e{n}": n for n in (9, 12, 20, 26, 50)}
_STEP = lambda old, new, rn, seed, alpha: f"case when s.rn = {rn} then s.{seed} when s.rn > {rn} then e.{old} + (s.{new} - e.{old}) * {alpha} end"
#: Recursive indicators of daily bars as table osc: two recursions, the second over what the first gives.
_OSC = f"""{_SEG}, mv as (select *, close - lag(close) over k as move, high - lag(high) over k as up, lag(low) over k - low as dn from t window k as (partition by symbol, seg order by rn)),
 parts as (select *, greatest(move, 0) as gain, greatest(-move, 0) as loss, case when up > dn and up > 0 then up else 0 end as plus, case when dn > up and dn > 0 then dn else 0 end as minus from mv),
 seeds as (select *, {', '.join(f'avg({c}) over {_P(n)} as s_{k}' for k, (c, _, n) in _PREVIOUS.items())}, {', '.join(f'avg(close) over {_P(n)} as s_{k}' for k, n in _EMAS.items())} from parts),
 e as (select symbol, seg, rn, {', '.join(f'cast(null as double) as {k}' for k in [*_PREVIOUS, *_EMAS])} from seeds where rn = 1 union all select s.symbol, s.seg, s.rn,
 {', '.join([*(_STEP(k, c, rn, 's_' + k, f'(1.0::double / {n})') for k, (c, rn, n) in _PREVIOUS.items()), *(_STEP(k, 'close', n, 's_' + k, f'(2.0::double / {n + 1})') for k, n in _EMAS.items())])} from e join seeds s on s.symbol = e.symbol and s.seg = e.seg and s.rn = e.rn + 1),
 dxs as (select *, case when a > 0 then case when p + m = 0 then 0 else 100 * abs(p - m) / (p + m) end end as dx, e12 - e26 as macd from e),
 seeds2 as (select *, avg(dx) over {_P(14)} as s_adx, avg(macd) over {_P(9)} as s_signal from dxs),
 e2 as (select symbol, seg, rn, cast(null as double) as adx, cast(null as double) as signal from seeds2 where rn = 1 union all select s.symbol, s.seg, s.rn, {_STEP('adx', 'dx', 27, 's_adx', '(1.0::double / 14)').replace('e.', 'f.')}, {_STEP('signal', 'macd', 34, 's_signal', '0.2::double').replace('e.', 'f.')}
 from e2 f join seeds2 s on s.symbol = f.symbol and s.seg = f.seg and s.rn = f.rn + 1),
 osc as (select x.symbol, x.seg, x.rn, y.open_time_ms, y.open, y.high, y.low, y.close, y.volume, y.quote_volume, y.taker_quote, y.trade_count, e9 as ema9, e20 as ema20, e50 as ema50, a as atr, adx, macd - signal as macd_histogram, 100 * p / a as plus_di, 100 * m / a as minus_di,
 case when g is null then null when l = 0 then case when g > 0 then 100 else 50 end else 100 - 100 / (1 + g / l) end as rsi from dxs x join e2 using (symbol, seg, rn) join t y on y.symbol = x.symbol and y.seg = x.seg and y.rn = x.rn)"""


@_register("w03_oscillators", f"with recursive {_OSC} select symbol, open_time_ms, {r('rsi', 5)} as rsi, {r('adx', 5)} as adx, {r('macd_histogram', 5)} as macd_histogram from osc")
def w03(spark, d):
    return rounded(_recursive(spark, d).select("symbol", "open_time_ms", "rsi", "adx", "macd_histogram"), 5)


# ---- joins ----
@_register("j01_asof_strict", f"with {FUNDING} select t.agg_id, f.funding_time_ms as matched_ms, f.rate as rate from ticks t asof left join funding f on t.symbol = f.symbol and t.ts_ms > f.funding_time_ms")
def j01(spark, d):
    x = joins.asof(ticks(spark, d), funding(spark, d), ["symbol"], "ts_ms", "funding_time_ms", bucket_ms=DAY_MS)
    return x.select("agg_id", F.col("matched.funding_time_ms").alias("matched_ms"), F.col("matched.rate").alias("rate"))


@_register("j02_asof_fresh", f"with {FUNDING} select t.agg_id, case when t.ts_ms - f.funding_time_ms <= {4 * HOUR_MS} then f.rate end as rate from ticks t asof left join funding f on t.symbol = f.symbol and t.ts_ms >= f.funding_time_ms")
def j02(spark, d):
    x = joins.asof(ticks(spark, d), funding(spark, d), ["symbol"], "ts_ms", "funding_time_ms", strict=False, max_age=4 * HOUR_MS, bucket_ms=DAY_MS)
    return x.select("agg_id", F.col("matched.rate").alias("rate"))


@_register("j03_grid_context", f"with {_HOURS}, h as (select symbol, open_time_ms + {HOUR_MS - 1} as close_ms, n from hours) select agg_id, n as hour_trades from ticks t join h on t.symbol = h.symbol and h.close_ms = t.ts_ms // {HOUR_MS} * {HOUR_MS} - 1")
def j03(spark, d):
    h = _hours(spark, d).select("symbol", (F.col("open_time_ms") + HOUR_MS - 1).alias("close_ms"), F.col("n").alias("hour_trades"))
    return ticks(spark, d).withColumn("close_ms", scalars.last_close_before(F.col("ts_ms"), HOUR_MS)).join(h, ["symbol", "close_ms"]).select("agg_id", "hour_trades")


@_register("j06_funding_paid", f"with {FUNDING}, e as (select agg_id, symbol, ts_ms, ts_ms + (1 + agg_id % 48) * {HOUR_MS} as exit_ms from ticks) select e.agg_id, {r('coalesce(sum(-f.rate), 0)', 8)} as paid from e left join funding f on e.symbol = f.symbol and f.funding_time_ms > e.ts_ms and f.funding_time_ms < e.exit_ms group by 1")
def j06(spark, d):
    e = ticks(spark, d).select("agg_id", "symbol", "ts_ms", (F.col("ts_ms") + (1 + F.col("agg_id") % 48) * HOUR_MS).alias("exit_ms"))
    return rounded(joins.interval_sum(e, funding(spark, d), ["symbol"], "ts_ms", "exit_ms", "funding_time_ms", -F.col("rate"), "paid", DAY_MS).select("agg_id", "paid"), 8)


_FWD = f"""f as (select *, lead(open_time_ms, 12) over k as t12, lead(open, 1) over k as e1, lead(close, 12) over k as x12, max(high) over (partition by symbol order by open_time_ms rows between 1 following and 12 following) as ph,
 min(low) over (partition by symbol order by open_time_ms rows between 1 following and 12 following) as pl from t window k as (partition by symbol order by open_time_ms))"""


@_register("j08_forward_outcomes", f"with {_SEG}, {_FWD}, o as (select symbol, open_time_ms, t12 = open_time_ms + {12 * DAY_MS} as ok, * exclude (symbol, open_time_ms) from f) select symbol, open_time_ms, case when ok then e1 end as entry, case when ok then x12 end as exit, case when ok then ph end as path_high, case when ok then pl end as path_low, case when t12 is null then 'OUT_OF_RANGE' when not ok then 'GAP' end as excluded from o")
def j08(spark, d):
    return joins.forward_outcomes(candles(spark, d), DAY_MS, 12).select("symbol", "open_time_ms", "entry", "exit", "path_high", "path_low", "excluded")


@_register("j16_leave_one_out", f"with {candles_sql()}, x as (select symbol, open_time_ms, ln(close / open) as r from candles) select a.symbol, a.open_time_ms, {r('quantile_cont(b.r, 0.5)', 8)} as others, count(*) filter (b.r > 0) as n_up from x a join x b on a.open_time_ms = b.open_time_ms and a.symbol <> b.symbol group by 1, 2")
def j16(spark, d):
    x = candles(spark, d).select("symbol", "open_time_ms", F.log(F.col("close") / F.col("open")).alias("r"))
    up = (F.col("r") > 0).cast("long")
    x = x.withColumn("n_up", F.sum(up).over(series.Window.partitionBy("open_time_ms")) - up)
    return rounded(joins.others_median(x, ["open_time_ms"], "r", "others").select("symbol", "open_time_ms", "others", "n_up"), 8)


@_register("j19_midrank", f"with {candles_sql()} select symbol, open_time_ms, {r('(rank() over (partition by open_time_ms order by trade_count) + (count(*) over (partition by open_time_ms, trade_count) - 1) / 2.0::double - 0.5::double) / count(*) over (partition by open_time_ms)')} as percentile from candles")
def j19(spark, d):
    return rounded(candles(spark, d).select("symbol", "open_time_ms", joins.midrank_percentile(["open_time_ms"], "trade_count").alias("percentile")))


# ---- rules, outcomes and metrics ----
def _breaks(spark, d):
    x = joins.forward_outcomes(series.window_features(candles(spark, d), DAY_MS), DAY_MS, 12)
    side = F.when((F.col("close") > F.col("recent_high")) & (F.col("previous_close") <= F.col("recent_high")), 1).when((F.col("close") < F.col("recent_low")) & (F.col("previous_close") >= F.col("recent_low")), -1)
    x = x.withColumn("direction", side).where("direction is not null and entry is not null")
    x = x.withColumns(scalars.execution_returns(F.col("direction"), F.col("entry"), F.col("exit"), 4.0, 2.0))
    best, worst = scalars.excursion(F.col("direction"), F.col("entry"), F.col("path_low"), F.col("path_high"))
    return x.withColumns({"mfe": best, "mae": worst, "year": F.year(F.timestamp_millis("open_time_ms"))})


_BREAKS = f"""{_SEG}, {_FWD}, q as (select *, max(high) {_over(-20, -1)} as rh, min(low) {_over(-20, -1)} as rl, lag(close) over (partition by symbol, seg order by open_time_ms) as pc from f),
b as (select *, case when close > rh and pc <= rh then 1 when close < rl and pc >= rl then -1 end as direction from q where t12 = open_time_ms + {12 * DAY_MS}),
o as (select symbol, open_time_ms, direction, year(make_timestamp(open_time_ms * 1000)) as year, e1 as entry, x12 as exit, direction * (x12 - e1) / e1 as gross_return, direction * (x12 * (1 - direction * 0.0002::double) - e1 * (1 + direction * 0.0002::double)) / e1 as ex,
 0.0004::double * (e1 * (1 + direction * 0.0002::double) + x12 * (1 - direction * 0.0002::double)) / e1 as fee_return, case when direction > 0 then (ph - e1) / e1 else -(pl - e1) / e1 end as mfe, case when direction > 0 then (pl - e1) / e1 else -(ph - e1) / e1 end as mae from b where direction is not null),
z as (select *, ex - fee_return as net_return from o)"""


@_register("f03_execution_returns", f"with {_BREAKS} select symbol, open_time_ms, direction, {r('gross_return', 8)} as gross_return, {r('fee_return', 8)} as fee_return, {r('net_return', 8)} as net_return, {r('mfe', 8)} as mfe, {r('mae', 8)} as mae, case when net_return > 0.0005::double then 'HIT' when net_return < -0.0005::double then 'MISS' else 'AMBIGUOUS' end as hit from z")
def f03(spark, d):
    x = _breaks(spark, d).withColumn("hit", scalars.hit_label(F.col("net_return"), 5))
    return rounded(x.select("symbol", "open_time_ms", "direction", "gross_return", "fee_return", "net_return", "mfe", "mae", "hit"), 8)


_METRIC = f"count(*) as n, {r('sum(net_return)')} as total, {r('avg(net_return)')} as mean, {r('quantile_cont(net_return, 0.5)')} as median, {r('avg(case when net_return > 0 then 1.0::double else 0 end)')} as win_rate, {r('sum(case when net_return > 0 then net_return end) / nullif(-sum(case when net_return < 0 then net_return end), 0)', 4)} as profit_factor"


@_register("a02_grouped_metrics", f"with {_BREAKS} select symbol, direction, cast(year as integer) as year, {_METRIC} from z group by grouping sets ((), (symbol), (direction), (year), (symbol, direction))")
def a02(spark, d):
    x = metrics.grouped(_breaks(spark, d), [[], ["symbol"], ["direction"], ["year"], ["symbol", "direction"]], ["symbol", "direction", "year"], metrics.trade_metrics())
    return rounded(x.withColumn("profit_factor", F.round("profit_factor", 4)))


@_register("a04_cube", f"with {_BREAKS} select symbol, direction, count(*) as n, {r('avg(mfe)')} as mfe, {r('avg(mae)')} as mae from z group by cube (symbol, direction)")
def a04(spark, d):
    return rounded(metrics.grouped(_breaks(spark, d), [[], ["symbol"], ["direction"], ["symbol", "direction"]], ["symbol", "direction"], [F.count("*").alias("n"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae")]))


@_register("a08_most_open", f"with {_BREAKS}, e as (select symbol, open_time_ms as t, 1 as d from z union all select symbol, open_time_ms + {12 * DAY_MS}, -1 from z), ss as (select symbol, t, d, sum(d) as s from e group by 1, 2, 3), c as (select symbol, sum(s) over (partition by symbol order by t, d) as o from ss) select symbol, cast(max(o) as bigint) as most_open from c group by 1")
def a08(spark, d):
    return metrics.most_open(_breaks(spark, d).withColumn("exit_ms", F.col("open_time_ms") + 12 * DAY_MS), ["symbol"], "open_time_ms", "exit_ms")


@_register("a09_drawdown", f"with {_BREAKS}, qq as (select symbol, open_time_ms, exp(sum(ln(greatest(1e-12::double, 1 + net_return))) over (partition by symbol order by open_time_ms)) as eq from z), p as (select *, greatest(1.0::double, max(eq) over (partition by symbol order by open_time_ms)) as peak from qq) select symbol, {r('arg_max(eq, open_time_ms) - 1')} as total_return, {r('min(eq / peak - 1)')} as max_drawdown from p group by 1")
def a09(spark, d):
    return rounded(metrics.drawdown(_breaks(spark, d), ["symbol"], "open_time_ms", "net_return"))


@_register("a10_buy_and_hold", f"with {candles_sql()} select symbol, cast(year(make_timestamp(open_time_ms * 1000)) as integer) as year, {r('arg_max(close, open_time_ms) / arg_min(open, open_time_ms) - 1')} as held from candles group by 1, 2")
def a10(spark, d):
    c = candles(spark, d).withColumn("year", F.year(F.timestamp_millis("open_time_ms")))
    return rounded(c.groupBy("symbol", "year").agg((F.max_by("close", "open_time_ms") / F.min_by("open", "open_time_ms") - 1).alias("held")))


@_register("a11_daily_calendar", f"with d as (select event_type as symbol, epoch_ms(date_trunc('day', cast(ts as timestamp))) as day, count(*) filter (value > 480) as n from events group by 1, 2), g as (select symbol, unnest(range((select min(day) from d), (select max(day) from d) + 1, {DAY_MS})) as day from (select distinct symbol from d)) select g.symbol, g.day, coalesce(d.n, 0) as n from g left join d on d.symbol = g.symbol and d.day = g.day")
def a11(spark, d):
    x = ticks(spark, d).select("symbol", F.expr(f"ts_ms - pmod(ts_ms, {DAY_MS}L)").alias("day"), (F.col("price") > 580).cast("long").alias("n"))
    return metrics.calendar(x, "symbol", "day", "n", DAY_MS)


@_register("a20_equal_count_bins", "with k as (select l_returnflag, l_quantity, l_extendedprice, floor((row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) * 10 - 1) / count(*) over (partition by l_returnflag)) as b from lineitem) select l_returnflag, cast(b as integer) as bin, count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high from k group by 1, 2")
def a20(spark, d):
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    x = metrics.equal_count_bins(table(spark, d, "lineitem").select("l_returnflag", *order), ["l_returnflag"], order, 10, "bin")
    return x.groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@_register("a21_trade_bars", f"with {TICKS}, b as (select symbol, ts_ms - ts_ms % {HOUR_MS} as open_time_ms, count(*) as n_trades, arg_min(price, (ts_ms, agg_id)) as open, arg_max(price, (ts_ms, agg_id)) as close, max(price) as high, min(price) as low, sum(price * qty) as notional, sum(case when is_buyer_maker then -price * qty else price * qty end) as signed_notional from ticks group by 1, 2) select symbol, open_time_ms, n_trades, open, close, high, low, {r('notional', 4)} as notional, {r('signed_notional', 4)} as signed_notional, {r('signed_notional / notional')} as signed_share from b")
def a21(spark, d):
    x = clean.trade_bars(ticks(spark, d), HOUR_MS)
    return x.withColumns({"notional": F.round("notional", 4) + F.lit(0.0), "signed_notional": F.round("signed_notional", 4) + F.lit(0.0), "signed_share": F.round("signed_share", 6) + F.lit(0.0)})


@_register("a22_trailing_flow", f"with {TICKS} select agg_id, sum(case when is_buyer_maker then -qty else qty end) over (partition by symbol order by ts_ms range between {HOUR_MS} preceding and current row) as flow from ticks")
def a22(spark, d):
    signed = F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty"))
    x = ticks(spark, d).select("symbol", "ts_ms", "agg_id", signed.alias("signed"))
    return series.trailing_sum(x, ["symbol"], "ts_ms", HOUR_MS, F.col("signed"), "flow").select("agg_id", "flow")


_LAG = lambda c, n: f"lag({c}, {n}) over (partition by symbol, seg order by rn)"
#: Features that the rules read, as table feat; and the rules over them as table rule.
_FEAT = f"""{_OSC}, ws as (select *, {_WIDTH} as width from osc), wp as (select *, {_LAG('close', 1)} as previous_close, max(high) {_over(-20, -1)} as recent_high, min(low) {_over(-20, -1)} as recent_low, {_LAG('macd_histogram', 1)} as macd1, {_LAG('macd_histogram', 2)} as macd2, {_LAG('rsi', 1)} as rsi1,
 greatest(0, (high - greatest(open, close)) / greatest(high - low, 1e-12::double)) as upper_wick, greatest(0, (least(open, close) - low) / greatest(high - low, 1e-12::double)) as lower_wick,
 100.0::double * len(list_filter(list(width) {_over(-119, 0)}, lambda w: w <= width)) / count(width) {_over(-119, 0)} as width_percentile from ws), feat as (select * from wp where ema50 is not null and adx is not null)"""
_UP, _DOWN = "(close > recent_high and previous_close <= recent_high)", "(close < recent_low and previous_close >= recent_low)"
_NEAR = lambda x: f"(width_percentile <= 20 and {x} between 0 and greatest(atr, close * 0.001::double))"
_IF = lambda *x: " + ".join(f"case when {c} then {p} else 0 end" for p, c in x)
_RULES_SQL = [
    ("squeeze_long", 1, _NEAR("recent_high - close"), f"60 + {_IF((15, 'ema20 > ema50'), (10, 'atr / close * 100 <= 2'))}", "false", "recent_low - atr * 0.25::double"),
    ("squeeze_short", -1, _NEAR("close - recent_low"), f"60 + {_IF((15, 'ema20 < ema50'), (10, 'atr / close * 100 <= 2'))}", "false", "recent_high + atr * 0.25::double"),
    ("breakout_long", 1, _UP, f"30 + {_IF((15, 'macd_histogram > 0 and macd_histogram > macd1'), (10, 'adx >= 20'), (10, 'ema20 > ema50'))}", f"{_UP} and macd_histogram > 0 and macd_histogram > macd1 and adx >= 20 and ema20 > ema50", "least(recent_high, close - atr)"),
    ("breakdown_short", -1, _DOWN, f"30 + {_IF((15, 'macd_histogram < 0 and macd_histogram < macd1'), (10, 'adx >= 20'), (10, 'ema20 < ema50'))}", f"{_DOWN} and macd_histogram < 0 and macd_histogram < macd1 and adx >= 20 and ema20 < ema50", "greatest(recent_low, close + atr)"),
    ("exhaustion_short", -1, "greatest(rsi, rsi1) >= 70", f"25 + {_IF((15, 'upper_wick >= 0.45::double'), (15, 'macd_histogram < macd1 and macd1 < macd2'), (10, 'close < ema9'))}", "false", "recent_high + atr * 0.5::double"),
    ("capitulation_long", 1, "least(rsi, rsi1) <= 30", f"25 + {_IF((15, 'lower_wick >= 0.45::double'), (15, 'macd_histogram > macd1 and macd1 > macd2'), (10, 'close > ema9'))}", "false", "recent_low - atr * 0.5::double"),
]
_EVALUATED = f"{_FEAT}, rule as (" + " union all ".join(f"select symbol, open_time_ms, {i} as place, '{n}' as family, {x} as direction, case when {needs} then {score} else 0 end as score, coalesce({trigger}, false) as triggered, {invalid} as invalidation from feat" for i, (n, x, needs, score, trigger, invalid) in enumerate(_RULES_SQL)) + ")"


def _features(spark, d):
    x = series.window_features(_recursive(spark, d), DAY_MS)
    size = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    lag = lambda c, n: F.lag(c, n).over(series.segment())
    return x.withColumns({"macd1": lag("macd_histogram", 1), "macd2": lag("macd_histogram", 2), "rsi1": lag("rsi", 1), "upper_wick": F.greatest(F.lit(0.0), (F.col("high") - F.greatest("open", "close")) / size), "lower_wick": F.greatest(F.lit(0.0), (F.least("open", "close") - F.col("low")) / size)}).where("ema50 is not null and adx is not null")


@_register("r05_rule_scores", f"with recursive {_EVALUATED} select symbol, open_time_ms, family, direction, score, triggered, {r('invalidation', 4)} as invalidation from rule where score > 0")
def r05(spark, d):
    x = rules.evaluate(_features(spark, d)).where("score > 0")
    return rounded(x.select("symbol", "open_time_ms", "family", "direction", "score", "triggered", "invalidation"), 4)


@_register("r10_strongest_rule", f"with recursive {_EVALUATED}, k as (select *, row_number() over (partition by symbol, open_time_ms, direction order by triggered desc, score desc, place) as k from rule where score > 0) select symbol, open_time_ms, direction, family, score, triggered from k where k = 1")
def r10(spark, d):
    return rules.strongest(rules.evaluate(_features(spark, d)).where("score > 0"), ["symbol", "open_time_ms"])


_COOLDOWN = 10 * DAY_MS
_T04 = f"""with recursive {_EVALUATED}, d0 as (select *, case when triggered then 'CONFIRMED' when score >= 60 then 'SETUP' when score >= 40 then 'WATCH' else 'IDLE' end as desired from rule), d1 as (select *, coalesce(lag(desired) over k, 'IDLE') as before, coalesce(count(*) filter (desired = 'IDLE') over (partition by symbol, family order by open_time_ms rows between unbounded preceding and 1 preceding), 0) as run from d0 window k as (partition by symbol, family order by open_time_ms)),
 d2 as (select *, last_value(invalidation ignore nulls) over (partition by symbol, family, run order by open_time_ms rows between unbounded preceding and 1 preceding) as held from d1), ch as (select symbol, family, open_time_ms, before, desired, case when desired = 'IDLE' then coalesce(held, invalidation) else invalidation end as invalidation from d2 where desired <> before),
 conf as (select symbol, family, open_time_ms as t from ch where desired = 'CONFIRMED'), nxt as (select a.symbol, a.family, a.t, min(b.t) as nt from conf a join conf b on a.symbol = b.symbol and a.family = b.family and a.t + {_COOLDOWN} <= b.t group by 1, 2, 3),
 taken as (select symbol, family, min(t) as t from conf group by 1, 2 union all select n.symbol, n.family, n.nt from taken x join nxt n on n.symbol = x.symbol and n.family = x.family and n.t = x.t)
 select ch.symbol, ch.family, open_time_ms, before, case when desired = 'IDLE' then 'INVALIDATED' else desired end as stage, {r('invalidation', 4)} as invalidation from ch left join taken on ch.symbol = taken.symbol and ch.family = taken.family and ch.open_time_ms > taken.t and ch.open_time_ms - taken.t < {_COOLDOWN}
 where taken.t is null and (desired <> 'IDLE' or before in ('WATCH', 'SETUP'))"""


@_register("t04_state_changes", _T04)
def t04(spark, d):
    found = rules.state_changes(rules.evaluate(_features(spark, d)), cooldown_ms=10 * DAY_MS, bucket_ms=90 * DAY_MS)
    return rounded(found.select("symbol", "family", "open_time_ms", "before", "stage", "invalidation"), 4)


_R26 = f"""with recursive {TICKS}, ep as (select symbol, user_id, ts_ms as e, ts_ms + (1 + agg_id % 48) * {HOUR_MS} as x, min(agg_id) as id from ticks group by 1, 2, 3, 4), ranked as (select *, row_number() over (partition by symbol, user_id order by x, e) as k from ep),
 nxt as (select a.symbol, a.user_id, a.k, min(b.k) as nk from ranked a join ranked b on a.symbol = b.symbol and a.user_id = b.user_id and b.e >= a.x group by 1, 2, 3), taken as (select symbol, user_id, cast(1 as bigint) as k from ranked where k = 1 union all select n.symbol, n.user_id, n.nk from taken t join nxt n on n.symbol = t.symbol and n.user_id = t.user_id and n.k = t.k)
 select symbol, user_id, id as agg_id, e as entry_ms, x as exit_ms from ranked join taken using (symbol, user_id, k)"""


@_register("r26_non_overlapping", _R26)
def r26(spark, d):
    e = ticks(spark, d).select("symbol", "user_id", "agg_id", F.col("ts_ms").alias("entry_ms"), (F.col("ts_ms") + (1 + F.col("agg_id") % 48) * HOUR_MS).alias("exit_ms"))
    return rules.non_overlapping(e, ["symbol", "user_id"], "entry_ms", "exit_ms", ["agg_id"])


# ---- inference ----
@_register("b05_block_bootstrap", f"""with {PRINTS}, dd as (select symbol, ts_ms // {DAY_MS} as day, cast(sum(drift) as bigint) as s, count(*) as c from prints group by 1, 2), p as (select *, row_number() over (partition by symbol order by day) - 1 as place, count(*) over (partition by symbol) as days from dd),
 dbl as (select symbol, days, unnest([place, place + days]) as pos, s, c from p), cum as (select *, sum(s) over (partition by symbol order by pos) as st, sum(c) over (partition by symbol order by pos) as sc from dbl),
 blocks as (select symbol, days, rep, unnest(range((days + 13) // 14)) as blk from (select distinct symbol, days from p) y, range(200) as x(rep)), plan as (select symbol, days, rep, blk, cast(('0x' || substr(md5('7|' || rep || '|' || blk), 1, 8)) as bigint) % days as b, least(14, days - blk * 14) as size from blocks),
 m as (select plan.symbol, plan.rep, cast(sum(f.st - (a.st - a.s)) as double) / cast(sum(f.sc - (a.sc - a.c)) as double) as mean from plan join cum a on a.symbol = plan.symbol and a.pos = plan.b join cum f on f.symbol = plan.symbol and f.pos = plan.b + plan.size - 1 group by 1, 2)
 select symbol, {r('quantile_cont(mean, 0.025)')} as low, {r('quantile_cont(mean, 0.975)')} as high, count(*) filter (mean <= 0) as n_below from m group by 1""")
def b05(spark, d):
    x = prints(spark, d).groupBy("symbol", F.expr(f"ts_ms div {DAY_MS}").alias("day")).agg(F.sum("drift").alias("s"), F.count("*").alias("c"))
    x = x.withColumn("place", F.row_number().over(series.Window.partitionBy("symbol").orderBy("day")) - 1)
    return rounded(inference.intervals(inference.block_bootstrap_means(x, "symbol", "place", "s", "c", 200, 14), "symbol"))


@_register("b13_naive_bayes", f"""with t as (select toxic, lang, cast(n_chars as double) as n_chars from documents join labels using (doc_id)), c as (select toxic, lang, count(*) as c from t group by 1, 2), v as (select count(distinct lang) as v from t), n as (select toxic, count(*) as n, {r('avg(n_chars)', 4)} as mean_chars, {r('var_pop(n_chars)', 1)} as var_chars from t group by 1) select toxic, lang, n, mean_chars, var_chars, {r('ln((c + 1.0::double) / (n + v))')} as log_p from c join n using (toxic), v""")
def b13(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("toxic", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    moments, p = inference.naive_bayes(t, "toxic", ["n_chars"], ["lang"])
    x = p.join(moments, "toxic").select("toxic", F.col("value").alias("lang"), "n", F.round("mean_n_chars", 4).alias("mean_chars"), F.round("var_n_chars", 1).alias("var_chars"), "log_p")
    return rounded(x)


@_register("b10_holm", "with p as (select event_type as name, least(1, count(*) filter (value > 450) / (10.0::double * count(*))) as p from events group by 1), k as (select *, least(1, (count(*) over () - row_number() over (order by p, name) + 1) * p) as raw from p), a as (select name, p, max(raw) over (order by p, name rows between unbounded preceding and current row) as adjusted from k) select name, round(p, 8) as p, round(adjusted, 8) as adjusted, adjusted <= 0.05 as rejected from a")
def b10(spark, d):
    p = ticks(spark, d).groupBy(F.col("symbol").alias("name")).agg(F.least(F.lit(1.0), F.count_if(F.col("price") > 550) / (F.lit(10.0) * F.count("*"))).alias("p"))
    return rounded(inference.holm(p, "name", "p"), 8)


@_register("b17_walk_forward", f"with {candles_sql()}, e as (select min(open_time_ms) as a, max(open_time_ms) as b from candles), f as (select a, unnest(range(0, (b - a - {180 * DAY_MS}) // {30 * DAY_MS} + 1)) as fold from e), s as (select fold, a + {180 * DAY_MS} + fold * {30 * DAY_MS} as start from f) select cast(fold as integer) as fold, symbol, count(*) filter (open_time_ms < start - {DAY_MS // 4}) as train, count(*) filter (open_time_ms >= start and open_time_ms < start + {30 * DAY_MS}) as test from s, candles group by 1, 2")
def b17(spark, d):
    x = candles(spark, d).select("symbol", "open_time_ms")
    return walkforward.fold_counts(x, ["symbol"], "open_time_ms", walkforward.Schedule.of(x, "open_time_ms", 180 * DAY_MS, 30 * DAY_MS, DAY_MS // 4))


# ---- sets and coverage ----
@_register("o04_symmetric_difference", "(select c_custkey as k, 'no orders' as side from customer where c_custkey not in (select o_custkey from orders)) union all (select distinct o_custkey, 'no customer' from orders where o_custkey not in (select c_custkey from customer))")
def o04(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.join(o, "k", "left_anti").withColumn("side", F.lit("no orders")).union(o.join(c, "k", "left_anti").distinct().withColumn("side", F.lit("no customer")))


@_register("c01_sequence_breaks", "with g as (select event_type, event_id - lag(event_id) over (partition by event_type order by event_id) as s from events) select event_type, count(*) as n, count(*) filter (s > 1) as breaks, cast(coalesce(sum(case when s > 1 then s - 1 end), 0) as bigint) as lost from g group by 1")
def c01(spark, d):
    return coverage.sequence_breaks(table(spark, d, "events"), ["event_type"], ["event_id"], "event_id")


@_register("c07_interval_union", f"with {TICKS}, i as (select symbol, ts_ms as a, ts_ms + (1 + agg_id % 5) * 600000 as b from ticks), m as (select *, max(b) over (partition by symbol order by a, b rows between unbounded preceding and 1 preceding) as reach from i), n as (select *, case when reach is null or a > reach then 1 else 0 end as fresh from m), s as (select *, sum(fresh) over (partition by symbol order by a, b rows between unbounded preceding and current row) as isl from n), e as (select symbol, isl, max(b) - min(a) as c, max(case when fresh = 1 then a - reach end) as g from s group by 1, 2) select symbol, cast(sum(c) as bigint) as covered, coalesce(max(g), 0) as longest_gap, count(*) as islands from e group by 1")
def c07(spark, d):
    x = ticks(spark, d).select("symbol", F.col("ts_ms").alias("a"), (F.col("ts_ms") + (1 + F.col("agg_id") % 5) * 600000).alias("b"))
    return coverage.interval_union(x, ["symbol"], "a", "b")


_BOOK = "levels as (select l_returnflag as symbol, l_linestatus as side, round(l_extendedprice / 1000) as price, l_quantity as qty, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as o from lineitem), book as (select symbol, side, price, arg_max(qty, o) as qty from levels group by 1, 2, 3)"


def _book(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("side"), F.round(F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return coverage.book(x, ["symbol"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])


@_register("c03_book", f"with {_BOOK} select symbol, side, price, qty from book where qty > 0")
def c03(spark, d):
    return _book(spark, d).select("symbol", "side", "price", "qty")


@_register("c05_depth_walk", f"with {_BOOK}, w as (select *, sum(qty) over (partition by symbol, side order by price) - qty as before from book where qty > 0), t as (select *, greatest(0.0::double, least(qty, 100.0::double - before)) as take from w) select symbol, side, sum(take) as filled, {r('sum(take * price) / nullif(sum(take), 0)')} as vwap, count(*) filter (take > 0) as levels from t group by 1, 2")
def c05(spark, d):
    return rounded(coverage.walk(_book(spark, d), ["symbol", "side"], 100.0))


@_register("c15_nearest_rank", "with k as (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice) as n, count(*) over (partition by l_suppkey) as c from lineitem) select l_suppkey, min(v) filter (n >= ceil(c * 0.95::double)) as p95 from k group by 1")
def c15(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(coverage.nearest_rank("l_extendedprice", 0.95).alias("p95"))


# ---- streams ----
@_register("t06_tumbling_stream", "with b as (select event_type as symbol, date_trunc('hour', ts) as start, count(*) as n, max(value) as high, min(value) as low from events group by 1, 2), m as (select max(ts) - interval 1 hour as mark from events) select symbol, cast(start as timestamptz) as start, n, high, low from b, m where start + interval 1 hour <= mark")
def t06(spark, d):
    return streams.replayed(streams.tumbling_bars(streams.file_stream(spark, d, "events")))


@_register("t08_stream_dedup", "select event_type, count(*) as n from events group by 1")
def t08(spark, d):
    x = streams.replayed(streams.unique_trades(streams.file_stream(spark, d, "events")))
    return x.groupBy("event_type").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range breaks with costs and forward outcomes, grouped five ways in one pass."""
    return a02(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
