"""Registered queries of gates, fee versions and clock bounds; they join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, policy, rules, signals
from .market import _EVALUATED, _features, _over, _register
from .views import DAY_MS, FUNDING, HOUR_MS, funding, ticks

_SCORE = lambda x, points: "case " + " ".join(f"when {x} >= {a}::double then {p}" for a, p in points) + " else 0 end"
_ZSCORE = lambda c: f"case when count({c}) {_over(-30, -1)} >= 2 and stddev_pop({c}) {_over(-30, -1)} > 0 then ({c} - avg({c}) {_over(-30, -1)}) / stddev_pop({c}) {_over(-30, -1)} else 0 end"
_FLOW = "2 * taker_quote - quote_volume"
#: What the gates read of a bar, and each rule with its gates.
_GATED = f"""{_EVALUATED},
 zs as (select symbol, open_time_ms, round({_ZSCORE('volume')}, 9) as vz, round({_ZSCORE('trade_count')}, 9) as tz, greatest(-1, least(1, sum({_FLOW}) {_over(-19, 0)} / sum(quote_volume) {_over(-19, 0)})) as pressure from osc),
 gate_rows as (select f.*, vz, tz, pressure, ({_FLOW}) / quote_volume as taker, (high - low) / close * 800::double as spread,
  (ema20 - lag(ema20, 3) over (partition by symbol, seg order by open_time_ms)) / atr as slope from feat f join zs using (symbol, open_time_ms)),
 gate_points as (select r.symbol, r.open_time_ms, r.family, r.direction, r.score as raw_score, spread,
  least(100, cast(round((case when r.direction * slope > 0 then 30 else 0 end + case when (ema20 > ema50) = (r.direction > 0) then 25 else 0 end
   + case when adx >= 20 then 15 when adx >= 15 then 8 else 0 end) / 0.7::double) as integer)) as trend_score,
  {_SCORE('greatest(vz, tz)', ((1.0, 35), (0.5, 25), (0.0, 10)))} + {_SCORE('r.direction * taker', ((0.10, 35), (0.03, 25), (0.0, 10)))}
   + {_SCORE('r.direction * pressure', ((0.05, 30), (0.015, 20), (0.0, 10)))} as participation_score,
  case when r.direction * tz >= 3 then 95 when r.direction * tz >= 2 then 75 when r.direction * tz >= 1 then 50 when r.direction * tz >= 0.5::double then 25 else 10 end as crowding_risk,
  case when spread > 15 then 0 when spread <= 7.5::double then 100 else 75 end as execution_score from rule r join gate_rows g using (symbol, open_time_ms)),
 gated as (select *, trend_score >= 60 and participation_score >= 60 and crowding_risk < 75 and execution_score >= 65 as passed,
  concat_ws(',', case when trend_score < 60 then 'trend' end, case when participation_score < 60 then 'participation' end, case when crowding_risk >= 75 then 'crowding' end,
   case when execution_score < 65 then 'execution' end, case when spread > 15 then 'spread' end) as failures from gate_points)"""


def _gated(spark, d):
    """Rules on bars with their gates; the z-score of trade counts stands in for that of funding, the range for the spread.

    Scores of whole counts can lie on a threshold, so they are read to nine digits.
    """
    f = _features(spark, d).withColumns(
        {
            **signals.slopes(),
            **{z: F.round(z, 9) for z in ("volume_zscore", "trade_count_zscore")},
            "taker_imbalance": (2 * F.col("taker_quote") - F.col("quote_volume")) / F.col("quote_volume"),
            "funding_zscore": F.round("trade_count_zscore", 9),
            "spread_bps": (F.col("high") - F.col("low")) / F.col("close") * 800.0,
            "spread_is_proxy": F.lit(False),
            "completeness": F.lit(1.0),
        }
    )
    return policy.entry_gates(rules.evaluate(f))


@_register("r07_entry_gates", f"""with recursive {_GATED}
 select symbol, open_time_ms, family, trend_score, participation_score, crowding_risk, execution_score, failures, passed from gated""")
def r07(spark, d):
    x = _gated(spark, d).withColumn("failures", F.array_join("failures", ","))
    return x.select("symbol", "open_time_ms", "family", "trend_score", "participation_score", "crowding_risk", "execution_score", "failures", "passed")


@_register("r09_gated_rules", f"""with recursive {_GATED}
 select symbol, open_time_ms, family, raw_score, case when raw_score = 0 then 0 when passed then greatest(raw_score, 80) else 0 end as score, passed as eligible,
  case when direction > 0 then 'FUTURES_LONG' else 'FUTURES_SHORT' end as futures_action, case when direction > 0 then 'SPOT_BUY' else 'SPOT_EXIT' end as spot_action from gated""")
def r09(spark, d):
    x = policy.apply_gates(_gated(spark, d), confirmed_score=80, keep_failed=False)
    label = lambda market: policy.action_label(F.lit(market), F.col("family"), F.col("direction"), F.col("informational"))
    return x.select("symbol", "open_time_ms", "family", "raw_score", "score", "eligible", label("futures").alias("futures_action"), label("spot").alias("spot_action"))


#: Fee rates in millionths at the funding times; they change every ten days.
_RATE = "case when funding_time_ms // 864000000 % 2 = 0 then 400 else 500 end"
_SLICES = f"""{FUNDING}, captures as (select symbol, funding_time_ms, {_RATE} as ppm from funding),
 near as (select t.*, p.funding_time_ms as p_ms, p.ppm as p_ppm from ticks t asof left join captures p on t.symbol = p.symbol and t.ts_ms >= p.funding_time_ms),
 around as (select n.*, q.ppm as q_ppm from near n asof left join captures q on n.symbol = q.symbol and n.ts_ms < q.funding_time_ms),
 slices as (select *, case when p_ms is null then 'NO_CAPTURE_BEFORE' when p_ms = ts_ms or p_ppm = q_ppm then 'RESOLVED' when q_ppm is null then 'PENDING_OPEN_TAIL' else 'INCONCLUSIVE_FEE_VERSION' end as fee_status from around)"""


def _slices(spark, d):
    rate = F.when(F.expr("(funding_time_ms div 864000000) % 2 = 0"), 400.0).otherwise(500.0)
    captures = funding(spark, d).select("symbol", "funding_time_ms", rate.alias("ppm"))
    return policy.fee_versions(ticks(spark, d), captures, ["symbol"], "ts_ms", "funding_time_ms", "ppm", DAY_MS)


@_register("j22_fee_versions", f"with {_SLICES} select agg_id, fee_status, case when fee_status = 'RESOLVED' then p_ppm::double end as fee_rate from slices")
def j22(spark, d):
    return _slices(spark, d).select("agg_id", "fee_status", "fee_rate")


@_register("a24_position_fees", f"""with {_SLICES} select symbol, user_id, count(*) as slices, count(*) filter (fee_status <> 'RESOLVED') as unresolved,
 case when count(*) filter (fee_status <> 'RESOLVED') = 0 then sum(round(price * qty * 100) * p_ppm) end as fee from slices group by 1, 2""")
def a24(spark, d):
    # cents times millionths are whole numbers, which doubles hold exactly
    x = _slices(spark, d).withColumn("cents", F.round(F.col("price") * F.col("qty") * 100))
    return policy.position_fees(x, ["symbol", "user_id"], "cents")


_AGE_MS = 6 * HOUR_MS
_NS = lambda since, ppm: f"cast(ts_ms * 1000000 - (s_ms * 1000000 + {since}) as hugeint) * {1_000_000 + ppm}"
_BOUNDS = f"""{FUNDING}, near as (select t.*, ts_ms - ts_ms % 10000 + 5000 as cutoff_ms, s.funding_time_ms as s_ms from ticks t asof left join funding s on t.symbol = s.symbol and t.ts_ms >= s.funding_time_ms),
 usable as (select *, coalesce(ts_ms >= s_ms + 25 and ts_ms - s_ms - 25 <= {_AGE_MS}, false) as ok from near),
 bounds as (select *, case when ok then s_ms + 3 + cast({_NS(20_000_000, -1000)} // 1000000000000 as bigint) - 1 end as lower_ms,
  case when ok then s_ms + 3 + cast(({_NS(0, 1000)} + 999999999999) // 1000000000000 as bigint) + 1 end as upper_ms from usable)"""


def _bounds(spark, d):
    at = F.col("funding_time_ms") * 1_000_000
    samples = funding(spark, d).select("symbol", "funding_time_ms", (F.col("funding_time_ms") + 3).alias("server_ms"), at.alias("request_ns"), (at + 20_000_000).alias("first_byte_ns"), (at + 25_000_000).alias("available_ns"))
    x = joins.asof(ticks(spark, d), samples, ["symbol"], "ts_ms", "funding_time_ms", strict=False, bucket_ms=DAY_MS)
    x = x.withColumns({"receipt_ns": F.col("ts_ms") * 1_000_000, "cutoff_ms": F.expr("ts_ms - pmod(ts_ms, 10000L) + 5000")})
    return policy.clock_bounds(x, "receipt_ns", "cutoff_ms", _AGE_MS * 1_000_000)


@_register("c09_clock_cutoff", f"""with {_BOUNDS} select agg_id, lower_ms, upper_ms,
 case when s_ms is null then 'clock_sample_missing' when ts_ms < s_ms + 25 then 'clock_sample_not_yet_available' when not ok then 'clock_sample_stale' when upper_ms <= cutoff_ms then 'receipt_interval_at_or_before_cutoff'
  when lower_ms > cutoff_ms then 'receipt_interval_after_cutoff' else 'receipt_interval_straddles_cutoff' end as reason,
 case when ok and upper_ms <= cutoff_ms then 'ADMISSIBLE' when ok and lower_ms > cutoff_ms then 'LATE' else 'CLOCK_INCONCLUSIVE' end as verdict from bounds""")
def c09(spark, d):
    return _bounds(spark, d).select("agg_id", "lower_ms", "upper_ms", "reason", "verdict")


@_register("c17_first_reaching", f"""with {_BOUNDS}, walked as (select *, max(lower_ms) over (partition by symbol order by ts_ms, agg_id rows between unbounded preceding and current row) as top,
  row_number() over (partition by symbol order by ts_ms, agg_id) as k from bounds where lower_ms is not null),
 peaks as (select symbol, top, arg_min(agg_id, k) as agg_id from walked group by 1, 2),
 targets as (select symbol, unnest(generate_series(arg_min(lower_ms, k) // {DAY_MS}, max(top) // {DAY_MS})) * {DAY_MS} as target_ms from walked group by 1)
 select t.symbol, target_ms, agg_id from targets t asof join peaks p on t.symbol = p.symbol and t.target_ms <= p.top""")
def c17(spark, d):
    return policy.first_reaching(_bounds(spark, d), ["symbol"], ["ts_ms", "agg_id"], "lower_ms", DAY_MS).select("symbol", "target_ms", "agg_id")
