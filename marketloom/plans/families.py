"""Registered queries of volume confirmation, filters, evidence families and their panels; they join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, families, kernels, series, volume
from .market import _LAG, _OSC, _SEG, _over, _recursive, _register, r, rounded
from .studies import _signed
from .views import DAY_MS, TICKS, candles, candles_sql, ticks

# Bars with planted faults by day: open ones, wrong close times, negative volumes, days without volume and days without movement.
_DAY = f"(open_time_ms // {DAY_MS})"
_FLAT = f"{_DAY} % 700 between 100 and 140"
_FAULTY = f"""{candles_sql()}, faulty as (select symbol, open_time_ms, {_DAY} as k, close_time_ms + case when {_DAY} % 189 = 0 then 1 else 0 end as close_time_ms, {_DAY} % 197 <> 0 as is_closed,
 {', '.join(f'case when {_FLAT} then 100 else {c} end as {c}' for c in ('open', 'high', 'low', 'close'))},
 {', '.join(f'case when {_DAY} % 400 < 25 then 0 when {_DAY} % 183 = 0 then -{c} else {c} end as {c}' for c in ('quote_volume', 'taker_quote'))} from candles),
judged as (select *, is_closed and close_time_ms = open_time_ms + {DAY_MS - 1} as edge, quote_volume >= 0 as amount from faulty)"""


def _faulty(spark, d):
    k = F.floor(F.col("open_time_ms") / DAY_MS)
    x = candles(spark, d).withColumns({"close_time_ms": F.col("close_time_ms") + (k % 189 == 0).cast("long"), "is_closed": k % 197 != 0})
    x = x.withColumns({c: F.when((k % 700).between(100, 140), F.lit(100.0)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    return x.withColumns({c: F.when(k % 400 < 25, F.lit(0.0)).when(k % 183 == 0, -F.col(c)).otherwise(F.col(c)) for c in ("quote_volume", "taker_quote")})


_W = lambda n: f"(partition by symbol, seg order by rn rows between {n - 1} preceding and current row)"
_VPCI = f"""{_FAULTY}, v as (select *, case when open_time_ms - lag(open_time_ms) over (partition by symbol order by open_time_ms) = {DAY_MS} then 0 else 1 end as b from judged where edge and amount),
 s as (select *, cast(sum(b) over (partition by symbol order by open_time_ms) as bigint) as seg from v), n as (select *, row_number() over (partition by symbol, seg order by open_time_ms) as rn from s),
 tr as (select *, greatest(high - low, abs(high - lag(close) over k), abs(low - lag(close) over k)) as true_range from n window k as (partition by symbol, seg order by rn)),
 sums as (select *, sum(quote_volume) over {_W(5)} as q5, sum(quote_volume) over {_W(20)} as q20, sum(close * quote_volume) over {_W(5)} as cq5, sum(close * quote_volume) over {_W(20)} as cq20,
  avg(close) over {_W(5)} as c5, avg(close) over {_W(20)} as c20, avg(true_range) over {_W(20)} as atr from tr),
 vals as (select *, case when rn >= 20 and q5 > 0 and q20 > 0 and atr > 0 then (cq20 / q20 - c20) * (cq5 / q5 / c5) * (q5 / 5) / (q20 / 20) / atr end as value from sums),
 sig as (select *, case when count(value) over {_W(5)} = 5 and q5 > 0 then sum(value * quote_volume) over {_W(5)} / q5 end as signal, value - lag(value, 3) over (partition by symbol, seg order by rn) as slope from vals)"""


@_register("w19_confirmation", f"""with {_VPCI}, done as (select * from sig where signal is not null and slope is not null)
 select j.symbol, j.open_time_ms, {r('value')} as vpci, {r('signal')} as vpci_signal, {r('slope')} as vpci_slope from judged j left join done d on d.symbol = j.symbol and d.open_time_ms = j.open_time_ms""")
def w19(spark, d):
    return rounded(volume.confirmation(_faulty(spark, d), DAY_MS).select("symbol", "open_time_ms", "vpci", "vpci_signal", "vpci_slope"))


_ROWS = lambda n: f"over (partition by symbol order by open_time_ms rows between {n - 1} preceding and current row)"


def _reason(n: int, dry: str, still: str) -> str:
    return f"""case when count(*) {_ROWS(n)} < {n} then 'immature_window' when bool_or(not is_closed) {_ROWS(n)} then 'unclosed_candle' when bool_or(not edge) {_ROWS(n)} then 'invalid_candle_boundary'
 when bool_or(not amount) {_ROWS(n)} then 'invalid_feature_input' when bool_or(gap) {_ROWS(n - 1)} then 'noncontiguous_window' when {dry} then 'zero_quote_volume_denominator' {still} end"""


@_register("w20_missing_reasons", f"""with {_FAULTY}, w as (select *, coalesce(open_time_ms - lag(open_time_ms) over k <> {DAY_MS}, false) as gap, greatest(high - low, abs(high - lag(close) over k), abs(low - lag(close) over k)) as tr,
  {', '.join(f'sum(quote_volume) {_ROWS(n)} as q{n}' for n in (3, 5, 12, 20))} from judged window k as (partition by symbol order by open_time_ms)),
 a as (select *, case when count(*) {_ROWS(20)} = 20 then avg(tr) {_ROWS(20)} end as atr from w)
 select symbol, open_time_ms, {_reason(12, 'q3 <= 0 or q12 <= 0', '')} as taker_reason,
  {_reason(24, f'bool_or(q5 <= 0 or q20 <= 0) {_ROWS(5)}', f"when bool_or(coalesce(atr <= 0, true)) {_ROWS(5)} then 'zero_atr'")} as vpci_reason from a""")
def w20(spark, d):
    return volume.missing_reasons(_faulty(spark, d), DAY_MS).select("symbol", "open_time_ms", "taker_reason", "vpci_reason")


_MEAN = lambda c: f"avg({c}) {_over(-20, -1)}"
_FILTERS = ["di_spread", "di_balance", "macd_delta_atr", "directional_taker_delta", "range_contraction", "volume_contraction"]


@_register("w26_directional_filters", f"""with recursive {_OSC}, f as (select *, case when close > open then 1 else -1 end as direction, {_LAG('macd_histogram', 1)} as macd_before, case when {_DAY} % 5 <> 0 then {_signed(3)} end as delta,
  case when quote_volume > 0 and {_DAY} % 10 <> 0 then 2 * taker_quote / quote_volume - 1 end as own, (high - low) / nullif({_MEAN('high - low')}, 0) as rr, quote_volume / nullif({_MEAN('quote_volume')}, 0) as vr from osc)
 select symbol, open_time_ms, {r('direction * (plus_di - minus_di)', 5)} as di_spread, {r('case when plus_di + minus_di = 0 then 0 else direction * (plus_di - minus_di) / (plus_di + minus_di) end', 5)} as di_balance,
  {r('case when atr > 0 then direction * (macd_histogram - macd_before) / atr end', 5)} as macd_delta_atr, {r('direction * coalesce(delta, own)', 5)} as directional_taker_delta,
  case when delta is not null then 'taker_delta_3' when own is not null then 'current_taker_imbalance' else 'unavailable' end as taker_delta_source, {r('1 - rr', 5)} as range_contraction, {r('1 - vr', 5)} as volume_contraction from f""")
def w26(spark, d):
    k = F.floor(F.col("open_time_ms") / DAY_MS)
    usual = lambda c: F.avg(c).over(series.prior(20))
    x = _recursive(spark, d).withColumn("_range", F.col("high") - F.col("low")).withColumns(
        {
            "direction": F.when(F.col("close") > F.col("open"), 1).otherwise(-1), "macd_before": F.lag("macd_histogram").over(series.segment()),
            "taker_delta_3": F.when(k % 5 != 0, evidence.taker_delta(3)), "taker_imbalance": F.when((F.col("quote_volume") > 0) & (k % 10 != 0), 2 * F.col("taker_quote") / F.col("quote_volume") - 1),
            "range_ratio": F.try_divide(F.col("_range"), usual("_range")), "volume_ratio": F.try_divide(F.col("quote_volume"), usual("quote_volume")),
        }
    )
    return rounded(volume.directional_filters(x).select("symbol", "open_time_ms", *_FILTERS, "taker_delta_source"), 5)


_STEP = lambda old, new, n, alpha: f"case when s.rn = {n} then s.s_{old} when s.rn > {n} then e.{old} + (s.{new} - e.{old}) * {alpha} end"


@_register("w31_hourly_trend", f"""with recursive {_SEG}, seeds as (select *, avg(close) {_over(-23, 0)} as s_fast, avg(close) {_over(-95, 0)} as s_slow, avg(true_range) {_over(-95, 0)} as s_spread from t),
 e as (select symbol, seg, rn, cast(null as double) as fast, cast(null as double) as slow, cast(null as double) as spread from seeds where rn = 1 union all
  select s.symbol, s.seg, s.rn, {_STEP('fast', 'close', 24, '(2.0::double / 25)')}, {_STEP('slow', 'close', 96, '(2.0::double / 97)')}, {_STEP('spread', 'true_range', 96, '(1.0::double / 96)')} from e join seeds s on s.symbol = e.symbol and s.seg = e.seg and s.rn = e.rn + 1)
 select t.symbol, t.open_time_ms, {r('case when spread > 0 then (fast - slow) / spread end', 5)} as trend from e join t on t.symbol = e.symbol and t.seg = e.seg and t.rn = e.rn""")
def w31(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS).select("symbol", "seg", "open_time_ms", "high", "low", "close")
    x = kernels.recursive_series(x, run_in=volume.TREND_RUN_IN, kernel=volume.trend, results=volume.TREND_NAMES)
    return rounded(x.select("symbol", "open_time_ms", "trend"), 5)


_PAST = lambda c, n=60: f"list({c}) {_over(-n, -1)}"
_MAD = lambda past, m: f"list_aggregate(list_transform({past}, lambda v: abs(v - {m})), 'quantile_cont', 0.5)"
_STRENGTH = lambda v, support="1": f"cast(floor(1000000.0::double * abs({v}) / (1 + abs({v})) * {support}) as bigint)"


@_register("w35_price_momentum", f"""with {_SEG}, q as (select *, ln(close / lag(close) over k) as r1, ln(close / lag(close, 12) over k) as rs from t window k as (partition by symbol, seg order by open_time_ms)),
 p as (select *, {_PAST('r1')} as p1, {_PAST('rs')} as ps from q), m as (select *, list_aggregate(p1, 'quantile_cont', 0.5) as m1, list_aggregate(ps, 'quantile_cont', 0.5) as ms from p),
 a as (select *, {_MAD('p1', 'm1')} as a1, {_MAD('ps', 'ms')} as a_s from m),
 st as (select *, case when rn <= 72 then 'FEATURE_NOT_READY_WARMUP' when a1 <= 0 or a_s <= 0 then 'FEATURE_NOT_READY_ZERO_SCALE' else 'READY' end as status from a),
 c as (select *, case when status = 'READY' then (r1 / (1.4826::double * a1) + rs / (1.4826::double * a_s)) / 2 end as composite from st), f as (select *, {_STRENGTH('composite')} as strength from c)
 select symbol, open_time_ms, status, {r('composite')} as composite, case when strength > 0 then cast(sign(composite) as integer) when strength = 0 then 0 end as direction, strength as strength_micros from f""")
def w35(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS).select("symbol", "seg", "open_time_ms", "close")
    return rounded(families.price_momentum(x, 60).select("symbol", "open_time_ms", "status", "composite", "direction", "strength_micros"))


_FLOW = f"""{_SEG}, fl as (select symbol, seg, rn, open_time_ms, case when {_DAY} % 400 < 3 then 0 else quote_volume end as total, case when {_DAY} % 400 < 3 then 0 else 2 * taker_quote - quote_volume end as signed from t),
 flow as (select *, case when total > 0 then signed / total end as share from fl)"""


def _flow(spark, d):
    k = F.floor(F.col("open_time_ms") / DAY_MS)
    x = series.with_segments(candles(spark, d), DAY_MS).select("symbol", "seg", "open_time_ms", *(F.when(k % 400 < 3, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("quote_volume", "taker_quote")))
    return families.flow_proxy(x, DAY_MS)


@_register("w43_flow_proxy", f"with {_FLOW} select symbol, open_time_ms, {r('signed', 2)} as signed_notional, {r('total', 2)} as total_notional, {r('share')} as signed_share, coalesce((lead(open_time_ms) over (partition by symbol order by open_time_ms) - open_time_ms) // {DAY_MS} - 1, 0) as missing_after from flow")
def w43(spark, d):
    x = _flow(spark, d).withColumns({c: F.round(c, 2) + F.lit(0.0) for c in ("signed_notional", "total_notional")})
    return rounded(x.select("symbol", "open_time_ms", "signed_notional", "total_notional", "signed_share", "missing_after"))


@_register("w36_participation", f"""with {_FLOW}, p as (select *, {_PAST('coalesce(share, 0)')} as past, {_PAST('total')} as totals, count(*) filter (share is null) {_over(-60, 0)} as dark from flow),
 m as (select *, list_aggregate(past, 'quantile_cont', 0.5) as med, list_aggregate(totals, 'quantile_cont', 0.5) as usual from p), a as (select *, {_MAD('past', 'med')} as mad from m),
 st as (select *, case when dark > 0 then 'INCONCLUSIVE_DATA' when rn <= 60 then 'FEATURE_NOT_READY_WARMUP' when mad <= 0 then 'FEATURE_NOT_READY_ZERO_SCALE' when usual <= 0 then 'DATA_INVALID_ARITHMETIC' else 'READY' end as status from a),
 u as (select *, case when status = 'READY' then share / (1.4826::double * mad) end as scaled, case when status = 'READY' then least(total / usual, 1) end as activity from st), f as (select *, {_STRENGTH('scaled', 'activity')} as strength from u)
 select symbol, open_time_ms, status, {r('scaled')} as scaled_share, {r('activity')} as activity, case when strength > 0 then cast(sign(share) as integer) when strength = 0 then 0 end as direction, strength as strength_micros from f""")
def w36(spark, d):
    return rounded(families.participation(_flow(spark, d), 60).select("symbol", "open_time_ms", "status", "scaled_share", "activity", "direction", "strength_micros"))


# Observations of six families by symbol and day, from trades; the last of a family and slot counts where one is asked for.
_NAMES = families.DIRECTIONAL + families.CONTEXT
_CASE = " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES))
_RAW = f"""{TICKS}, raw as (select symbol, ts_ms - ts_ms % {DAY_MS} as open_ms, agg_id, user_id, case (agg_id // 3) % 6 {_CASE} end as family, cast(sign(qty - 4) as integer) as direction, cast(round(price * 10000) as bigint) % 1000001 as strength_micros,
  case agg_id % 90 when 0 then 'FEATURE_NOT_READY' when 1 then 'INCONCLUSIVE_DATA' when 2 then 'DATA_INVALID' else 'READY' end as readiness, agg_id % 161 <> 0 as closed, agg_id % 153 <> 0 as causal,
  ts_ms - ts_ms % {DAY_MS} + {DAY_MS} as close_ms, ts_ms - ts_ms % {DAY_MS} + {DAY_MS + 5000} as cutoff_ms, ts_ms - ts_ms % {DAY_MS} + {DAY_MS} + agg_id % 50 - case when agg_id % 159 = 0 then 100 else 0 end as event_ms from ticks)"""
_OBS = f"""{_RAW}, obs as (select *, event_ms + agg_id % 30 - case when agg_id % 167 = 0 then 100 else 0 end + case when agg_id % 171 = 0 then 10000 else 0 end as receipt_ms from raw
 qualify row_number() over (partition by symbol, open_ms, family order by agg_id desc) = 1)"""


def _raw(spark, d):
    n = F.col("agg_id")
    family = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.floor(n / 3) % 6 + 1).cast("int"))
    opened = F.expr(f"ts_ms - pmod(ts_ms, {DAY_MS}L)")
    ready = F.when(n % 90 == 0, "FEATURE_NOT_READY").when(n % 90 == 1, "INCONCLUSIVE_DATA").when(n % 90 == 2, "DATA_INVALID").otherwise("READY")
    x = ticks(spark, d).select(
        "symbol", opened.alias("open_ms"), n, "user_id", family.alias("family"), F.signum(F.col("qty") - 4).cast("int").alias("direction"), (F.round(F.col("price") * 10000).cast("long") % 1000001).alias("strength_micros"),
        ready.alias("readiness"), (n % 161 != 0).alias("closed"), (n % 153 != 0).alias("causal"),
    )
    x = x.withColumns({"close_ms": F.col("open_ms") + DAY_MS, "cutoff_ms": F.col("open_ms") + (DAY_MS + 5000), "event_ms": F.col("open_ms") + DAY_MS + n % 50 - F.when(n % 159 == 0, 100).otherwise(0)})
    return x.withColumn("receipt_ms", F.col("event_ms") + n % 30 - F.when(n % 167 == 0, 100).otherwise(0) + F.when(n % 171 == 0, 10000).otherwise(0))


def _observations(spark, d):
    x = _raw(spark, d)
    return x.groupBy("symbol", "open_ms", "family").agg(F.max_by(F.struct(*(c for c in x.columns if c not in ("symbol", "open_ms", "family"))), "agg_id").alias("o")).select("symbol", "open_ms", "family", "o.*")


_SLOT = ["symbol", "open_ms"]
_COMPLETE = lambda table: f"""slots as (select symbol, open_ms, 6 - count(distinct family) as missing, count(distinct (family, user_id, direction, strength_micros)) - count(distinct family) as conflicting from {table} group by 1, 2),
 owned as (select symbol, open_ms, user_id, count(distinct family) as k from {table} group by 1, 2, 3), shares as (select symbol, open_ms, count(*) filter (k > 1) as shared from owned group by 1, 2),
 registered as (select s.*, shared, missing = 0 and conflicting = 0 and shared = 0 as complete from slots s join shares h on h.symbol = s.symbol and h.open_ms = s.open_ms)"""  # noqa: E731


@_register("r27_registered_evidence", f"with {_RAW}, {_COMPLETE('raw')} select symbol, open_ms, missing, conflicting, shared, complete from registered")
def r27(spark, d):
    return families.registered(_raw(spark, d), _SLOT, "family", "user_id", ["direction", "strength_micros"])


_LIST = lambda cond, name: f"list_sort(list('{name}:' || family) filter ({cond}))"
_NEAREST = lambda n: f"cast(sign(total) * ((2 * abs(total) + {n}) // {2 * n}) as bigint)"
_SCORE = f"""{_OBS}, {_COMPLETE('obs')}, g as (select symbol, open_ms, bool_and(closed) as closed, bool_and(causal) as causal,
  list_concat(coalesce({_LIST('event_ms < close_ms', 'PRECLOSE_EVENT_FORBIDDEN')}, []), coalesce({_LIST('event_ms > receipt_ms', 'POSTRECEIPT_EVENT_FORBIDDEN')}, []), coalesce({_LIST('receipt_ms > cutoff_ms', 'LATE_RECEIPT_FORBIDDEN')}, [])) as faults,
  {', '.join(f"coalesce({_LIST(f'readiness = {chr(39)}{s}{chr(39)}', s)}, []) as u{i}" for i, s in enumerate(families.UNREADY))},
  cast(sum(direction * strength_micros) as bigint) as total, count(*) filter (direction = 1) as up, count(*) filter (direction = -1) as down from obs join registered using (symbol, open_ms) where complete group by 1, 2),
 st as (select *, case when not closed or len(faults) > 0 then 'DATA_INVALID' when not causal then 'INCONCLUSIVE_DATA' {' '.join(f"when len(u{i}) > 0 then '{s}'" for i, s in enumerate(families.UNREADY))} else 'READY' end as status,
  array_to_string(case when not closed then ['UNCLOSED_CANDLE_FORBIDDEN'] when len(faults) > 0 then faults when not causal then ['CAUSAL_INPUTS_INCOMPLETE'] {' '.join(f'when len(u{i}) > 0 then u{i}' for i in range(3))} else [] end, ',') as reasons from g)"""


@_register("r20_evidence_score", f"""with {_SCORE} select symbol, open_ms, status, case when status <> 'READY' then 'NOT_AVAILABLE' when total >= {families.STRONG} and up >= 4 and down <= 1 then 'BULLISH_STRONG' when total >= {families.LEAN} and up >= 3 then 'BULLISH_LEAN'
 when total <= -{families.STRONG} and down >= 4 and up <= 1 then 'BEARISH_STRONG' when total <= -{families.LEAN} and down >= 3 then 'BEARISH_LEAN' else 'NEUTRAL' end as bias, case when status = 'READY' then {_NEAREST(6)} end as score_micros,
 case when status = 'READY' then up end as bullish, case when status = 'READY' then down end as bearish, case when status = 'READY' then 6 - up - down end as neutral, reasons from st""")
def r20(spark, d):
    x = _observations(spark, d)
    whole = families.registered(x, _SLOT, "family", "user_id", ["direction", "strength_micros"]).where("complete")
    return families.evidence_score(x.join(whole.select(*_SLOT), _SLOT), _SLOT)


_VOTES = ", ".join(f"'{n}'" for n in families.DIRECTIONAL)


@_register("r21_directional_panel", f"""with {_OBS}, e as (select *, case when not closed or event_ms > receipt_ms or receipt_ms > cutoff_ms then 'DATA_INVALID' when not causal then 'INCONCLUSIVE_DATA' else readiness end as ready, family in ({_VOTES}) as votes from obs),
 g as (select symbol, open_ms, count(*) filter (votes) as n, min(case ready when 'DATA_INVALID' then 1 when 'INCONCLUSIVE_DATA' then 2 when 'FEATURE_NOT_READY' then 3 end) filter (votes) as worst, cast(coalesce(sum(direction * strength_micros) filter (votes), 0) as bigint) as total,
  count(*) filter (votes and direction = 1) as up, count(*) filter (votes and direction = -1) as down, coalesce(array_to_string(list_sort(list(family) filter (not votes and ready <> 'READY')), ','), '') as context_withheld from e group by 1, 2)
 select symbol, open_ms, case worst when 1 then 'DATA_INVALID' when 2 then 'INCONCLUSIVE_DATA' when 3 then 'FEATURE_NOT_READY' else 'READY' end as status,
  case when worst is not null then 'WITHHELD' when up = 3 and down = 0 then 'BROAD_BULLISH_STATE' when up >= 2 and down = 0 then 'BULLISH_STATE_TILT' when down = 3 and up = 0 then 'BROAD_BEARISH_STATE' when down >= 2 and up = 0 then 'BEARISH_STATE_TILT' else 'MIXED_OR_NEUTRAL_STATE' end as state,
  case when worst is null then {_NEAREST(3)} end as agreement_micros, case when worst is null then up end as bullish, case when worst is null then down end as bearish, context_withheld from g""")
def r21(spark, d):
    return families.directional_panel(_observations(spark, d), _SLOT)
