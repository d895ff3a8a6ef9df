"""Registered queries of compression breakouts, with a window of 100 daily bars; they join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breakout, series
from .market import _OSC, _SEG, _over, _recursive, _register, r, rounded
from .views import DAY_MS, candles

_N = 100
_MEDIAN = lambda c, a, b: f"quantile_cont({c}, 0.5) {_over(a, b)}"
_NUMBERS = ["atr", "compression", "expansion", "atr_fraction", "activity", "imbalance_rz", "long_breakout", "short_breakout", "long_location", "short_location"]
_METRICS = f"""{_OSC}, b0 as (select * exclude (atr), greatest(high - low, abs(high - lag(close) over k), abs(low - lag(close) over k)) as tr, 2 * taker_quote / quote_volume - 1 as imbalance, lag(close) over k as previous_close,
  lag(close) over k as hour_close, lag(ema20) over k as hour_ema20, lag(ema50) over k as hour_ema50 from osc window k as (partition by symbol, seg order by open_time_ms)),
 b1 as (select *, list(tr) {_over(-_N, -1)} as trs, list(imbalance) {_over(-_N, -1)} as past, {_MEDIAN('quote_volume', -_N, -1)} as usual_volume, {_MEDIAN('tr', -12, -1)} as recent, {_MEDIAN('tr', -72, -13)} as base, max(high) {_over(-24, -1)} as upper, min(low) {_over(-24, -1)} as lower from b0),
 b2 as (select *, case when rn > {_N + 1} then list_sum(list_transform(trs, lambda v, i: v * case when i <= 14 then pow(13.0::double / 14, {_N - 14}) else pow(13.0::double / 14, {_N} - i) end / 14)) end as atr, list_aggregate(past, 'quantile_cont', 0.5) as center from b1),
 b3 as (select *, list_aggregate(list_transform(past, lambda v: abs(v - center)), 'quantile_cont', 0.5) as mad from b2),
 b4 as (select *, case when atr is null then 'CALCULATION_BAR_COUNT_NOT_COMPLETE' when high = low then 'ZERO_CURRENT_HIGH_LOW_RANGE' when mad = 0 then 'ZERO_TAKER_IMBALANCE_MAD' else 'READY' end as status from b3),
 metrics as (select *, recent / base as compression, tr / atr as expansion, atr / previous_close as atr_fraction, quote_volume / usual_volume as activity, (imbalance - center) / (1.4826::double * mad) as imbalance_rz, (close - upper) / atr as long_breakout, (lower - close) / atr as short_breakout,
  (close - low) / (high - low) as long_location, (high - close) / (high - low) as short_location from b4)"""


def _metrics(spark, d):
    back = lambda c: F.lag(c).over(series.segment())
    x = _recursive(spark, d).withColumns({"hour_close": back("close"), "hour_ema20": back("ema20"), "hour_ema50": back("ema50")})
    return breakout.metrics(x.select("symbol", "seg", "open_time_ms", "open", "high", "low", "close", "quote_volume", "taker_quote", "hour_close", "hour_ema20", "hour_ema50"), _N)


_READY = lambda c: c if c == "atr" else f"case when status = 'READY' then {c} end"


@_register("w38_breakout_metrics", f"with recursive {_METRICS} select symbol, open_time_ms, status, {', '.join(f'{r(_READY(c), 5)} as {c}' for c in _NUMBERS)} from metrics")
def w38(spark, d):
    return rounded(_metrics(spark, d).select("symbol", "open_time_ms", "status", *_NUMBERS), 5)


_SHARED = {"COMPRESSION_GT_0_70": "compression > 0.7", "CURRENT_EXPANSION_LT_1_50": "expansion < 1.5", "CURRENT_EXPANSION_GT_3_00": "expansion > 3", "ATR_FRACTION_LT_0_0035": "atr_fraction < 0.0035", "PRIOR_MEDIAN_QUOTE_VOLUME_LT_100000": "usual_volume < 100000", "ACTIVITY_LT_2_00": "activity < 2"}


def _failures(side: str, low: str, crossed: str, trend: str, flow: dict[str, str]) -> str:
    cases = {f"{side}_FIRST_CROSS_FAILED": crossed, f"{side}_BREAKOUT_ATR_LT_0_10": f"{low}_breakout < 0.1", f"{side}_BREAKOUT_ATR_GT_0_50": f"{low}_breakout > 0.5", f"{side}_CLOSE_LOCATION_LT_0_75": f"{low}_location < 0.75",
             f"{side}_STRICT_PRIOR_HOURLY_TREND_FAILED": f"not coalesce({trend}, false)", **_SHARED, **flow}
    return f"case when status = 'READY' then concat_ws(',', {', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in cases.items())}) end"


_GATED = f"""gated as (select *, {_failures('LONG', 'long', 'previous_close > upper', '(hour_close > hour_ema20 and hour_ema20 > hour_ema50)', {'LONG_TAKER_IMBALANCE_LT_0_20': 'imbalance < 0.2', 'LONG_TAKER_ROBUST_Z_LT_2_00': 'imbalance_rz < 2'})} as long_failures,
 {_failures('SHORT', 'short', 'previous_close < lower', '(hour_close < hour_ema20 and hour_ema20 < hour_ema50)', {'SHORT_TAKER_IMBALANCE_GT_NEG_0_20': 'imbalance > -0.2', 'SHORT_TAKER_ROBUST_Z_GT_NEG_2_00': 'imbalance_rz > -2'})} as short_failures from metrics)"""


@_register("r16_breakout_gates", f"with recursive {_METRICS}, {_GATED} select symbol, open_time_ms, long_failures, short_failures, case when long_failures = '' then 1 when short_failures = '' then -1 end as entry from gated")
def r16(spark, d):
    return breakout.gates(_metrics(spark, d)).select("symbol", "open_time_ms", "long_failures", "short_failures", "entry")


@_register("r16_breakout_exits", f"""with recursive {_METRICS}, p as (select *, case when status = 'READY' and close > upper then 1 when status = 'READY' and close < lower then -1 end as side, lead(open) over (partition by symbol, seg order by open_time_ms) as paid,
  list(close) over (partition by symbol, seg order by rn rows between 1 following and 24 following) as path from metrics),
 ended as (select *, list_filter(list_transform(path, lambda c, i: {{'held': i, 'reason': case when side * (c - (paid - side * 0.8::double * atr)) <= 0 then 'ADVERSE_CLOSE' when side * (c - case when side > 0 then upper else lower end) <= 0 then 'STRUCTURE_FAILURE'
  when side * (c - (paid + side * 3.0::double * atr)) >= 0 then 'PROFIT_CLOSE' when i = 24 then 'HARD_HORIZON' end}}), lambda z: z.reason is not null)[1] as first from p where side is not null)
 select symbol, open_time_ms, side, coalesce(first.reason, 'KEEP') as reason, cast(coalesce(first.held, coalesce(len(path), 0)) as integer) as held from ended""")
def r16_exits(spark, d):
    ready = F.col("status") == "READY"
    x = _metrics(spark, d).withColumn("side", F.when(ready & (F.col("close") > F.col("upper")), 1).when(ready & (F.col("close") < F.col("lower")), -1))
    return breakout.exits(x, "side").select("symbol", "open_time_ms", "side", "reason", "held")


_FLOW_SQL = "(2 * taker_quote - quote_volume) / quote_volume"


@_register("r17_prefilter", f"""with {_SEG}, c as (select *, max(high) {_over(-24, -1)} as upper, min(low) {_over(-24, -1)} as lower from t),
 f as (select *, concat_ws(',', case when rn <= 24 then 'PRIOR_CHANNEL_NOT_CONTIGUOUS' end, case when quote_volume <= 0 then 'ZERO_CURRENT_QUOTE_VOLUME' end, case when high = low then 'ZERO_CURRENT_HIGH_LOW_RANGE' end) as bad, case when close > upper then 'LONG' when close < lower then 'SHORT' end as side,
  case when close > upper then concat_ws(',', case when quote_volume < 200000 then 'CURRENT_QUOTE_VOLUME_LT_200000' end, case when {_FLOW_SQL} < 0.2 then 'LONG_TAKER_IMBALANCE_LT_0_20' end, case when (close - low) / (high - low) < 0.75 then 'LONG_CLOSE_LOCATION_LT_0_75' end)
  else concat_ws(',', case when quote_volume < 200000 then 'CURRENT_QUOTE_VOLUME_LT_200000' end, case when {_FLOW_SQL} > -0.2 then 'SHORT_TAKER_IMBALANCE_GT_NEG_0_20' end, case when (high - close) / (high - low) < 0.75 then 'SHORT_CLOSE_LOCATION_LT_0_75' end) end as fails from c)
 select symbol, open_time_ms, case when bad <> '' then 'INVALID_INPUT_INCONCLUSIVE' when side is null or fails <> '' then 'NECESSARY_GATE_FALSE' else 'CANDIDATE_' || side end as prefilter,
 case when bad <> '' then bad when side is null then 'NO_STRICT_PRIOR_CHANNEL_BREAKOUT' when fails <> '' then fails else side || '_NECESSARY_GATES_PASS' end as prefilter_reasons from f""")
def r17(spark, d):
    return breakout.prefilter(series.with_segments(candles(spark, d), DAY_MS)).select("symbol", "open_time_ms", "prefilter", "prefilter_reasons")
