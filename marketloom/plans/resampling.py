"""Registered queries of bootstraps on a shared calendar, with SQL that makes the same draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar_bootstrap as cb
from .market import _register, r, rounded
from .views import DAY_MS, PRINTS, prints

_REPS, _BLOCK = 100, 14
#: Variants of one panel: which opportunities each takes, by the print's drift.
_VARIANTS = (("every", "true"), ("strong", "drift >= 5"), ("strongest", "drift >= 8"))
_PAIRS = [("strong - every", "strong", "every"), ("strongest - strong", "strongest", "strong"), ("strong", "strong", None)]
_PANEL = f"""{PRINTS}, span as (select min(ts_ms // {DAY_MS}) as low, max(ts_ms // {DAY_MS}) - min(ts_ms // {DAY_MS}) + 1 as days from prints),
 panel as ({' union all '.join(f"select symbol, '{n}' as variant, ts_ms // {DAY_MS} - low as day, case when {c} then drift - spread else 0 end as gain, case when {c} then 1 else 0 end as taken, 1 as offered from prints, span" for n, c in _VARIANTS)})"""


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Gain, taken and offered opportunities by symbol, variant and day, and the number of days."""
    p = prints(spark, d).select("symbol", "drift", "spread", F.expr(f"ts_ms div {DAY_MS}L").alias("day"))
    low, high = p.agg(F.min("day"), F.max("day")).first()
    takes = [F.struct(F.lit(n).alias("variant"), F.expr(c).alias("takes")) for n, c in _VARIANTS]
    x = p.select("symbol", "drift", "spread", (F.col("day") - low).alias("day"), F.inline(F.array(*takes)))
    x = x.withColumns({"gain": F.when(F.col("takes"), F.col("drift") - F.col("spread")).otherwise(F.lit(0)), "taken": F.col("takes").cast("int"), "offered": F.lit(1)})
    return x.groupBy("symbol", "variant", "day").agg(*(F.sum(c).alias(c) for c in ("gain", "taken", "offered"))), high - low + 1


def _draws_sql(circular: bool, reps: int = _REPS, block: int = _BLOCK, seed: str = "7") -> str:
    """CTEs from the panel to ``resampled``."""
    below = "days" if circular else "days - size + 1"
    return f"""{_PANEL}, daily as (select symbol, variant, day, sum(gain) as gain, sum(taken) as taken, sum(offered) as offered from panel group by 1, 2, 3),
 blocks as (select rep, blk, days, least({block}, days - blk * {block}) as size from span, range({reps}) a(rep), range(10000) b(blk) where blk * {block} < days),
 plan as (select rep, days, size, cast(('0x' || substr(md5('{seed}|' || rep || '|' || blk), 1, 8)) as bigint) % ({below}) as start from blocks),
 drawn as (select rep, (start + unnest(range(size))) % days as day from plan),
 resampled as (select symbol, variant, rep, cast(sum(gain) as bigint) as gain, cast(sum(taken) as bigint) as taken, cast(sum(offered) as bigint) as offered from drawn join daily using (day) group by 1, 2, 3),
 points as (select symbol, variant, cast(sum(gain) as bigint) as gain, cast(sum(taken) as bigint) as taken, cast(sum(offered) as bigint) as offered from daily group by 1, 2)"""


def _contrast_sql(circular: bool, bottom: str) -> str:
    ratio = lambda t: f"case when {t}.{bottom} <> 0 then {t}.gain / cast({t}.{bottom} as double) else 0 end"
    pairs = ", ".join(f"('{n}', '{up}', {repr(low) if low else 'null'})" for n, up, low in _PAIRS)
    return f"""with {_draws_sql(circular)}, pairs as (select * from (values {pairs}) v(contrast, hi, lo)),
 base as (select contrast, u.symbol, {ratio('u')} - case when lo is null then 0 else {ratio('l')} end as effect from pairs join points u on u.variant = hi left join points l on l.variant = lo and l.symbol = u.symbol),
 tests as (select 0.05::double / count(*) as each from base),
 moved as (select contrast, u.symbol, u.rep, {ratio('u')} - case when lo is null then 0 else {ratio('l')} end as effect from pairs join resampled u on u.variant = hi left join resampled l on l.variant = lo and l.symbol = u.symbol and l.rep = u.rep),
 lists as (select contrast, symbol, list(effect) as e, count(*) filter (effect > 0) / cast(count(*) as double) as positive from moved group by 1, 2)
select b.contrast, b.symbol, {r('b.effect')} as effect, {r("list_aggregate(e, 'quantile_cont', 0.025)")} as low, {r("list_aggregate(e, 'quantile_cont', 0.975)")} as high, {r('positive')} as positive from base b join lists using (contrast, symbol)"""


@_register("b04_moving_block_contrasts", _contrast_sql(False, "offered"))
def b04(spark, d):
    x, days = _panel(spark, d)
    draws = cb.resampled(x, ["symbol", "variant"], "day", ["gain", "taken", "offered"], days, _REPS, _BLOCK, circular=False)
    points = x.groupBy("symbol", "variant").agg(F.sum("gain").alias("gain"), F.sum("offered").alias("offered"))
    return rounded(cb.contrasts(draws, points, ["symbol"], "variant", _PAIRS, "gain", "offered").select("contrast", "symbol", "effect", "low", "high", "positive"))


@_register("b03_paired_ratio_contrasts", _contrast_sql(True, "taken"))
def b03(spark, d):
    x, days = _panel(spark, d)
    draws = cb.resampled(x, ["symbol", "variant"], "day", ["gain", "taken"], days, _REPS, _BLOCK)
    points = x.groupBy("symbol", "variant").agg(F.sum("gain").alias("gain"), F.sum("taken").alias("taken"))
    return rounded(cb.contrasts(draws, points, ["symbol"], "variant", _PAIRS, "gain", "taken").select("contrast", "symbol", "effect", "low", "high", "positive"))


@_register(
    "b07_shared_calendar_bounds",
    f"""with {_draws_sql(True)}, rs as (select v.symbol, v.variant, v.rep, case when v.taken > 0 then v.gain / cast(v.taken as double) end as r, p.gain / cast(p.taken as double) as point from resampled v join points p using (symbol, variant))
select symbol, variant, {r('first(point)')} as point, count(r) as valid, count(*) - count(r) as invalid, {r('2 * first(point) - quantile_cont(r, 0.95)')} as lower,
 {r('case when first(point) <= 0 then 1 else (count(*) filter (r - point >= point) + 1) / cast(count(r) + 1 as double) end')} as p_value from rs group by 1, 2""",
)
def b07(spark, d):
    x, days = _panel(spark, d)
    draws = cb.resampled(x, ["symbol", "variant"], "day", ["gain", "taken"], days, _REPS, _BLOCK)
    points = x.groupBy("symbol", "variant").agg(F.sum("gain").alias("gain"), F.sum("taken").alias("taken"))
    return rounded(cb.calendar_bounds(draws, points, ["symbol", "variant"], "gain", "taken"))


@_register(
    "b06_exact_endpoints",
    f"""with {_draws_sql(True)}, v as (select *, row_number() over (partition by symbol, variant order by gain::decimal(38, 10) / taken::decimal(38, 10), rep) - 1 as k, count(*) over (partition by symbol, variant) as n from resampled where taken > 0)
select symbol, variant, max(n) as n, 'ready' as feasible, max(gain) filter (k = floor((n - 1) * 25 / 1000)) as low_top, max(taken) filter (k = floor((n - 1) * 25 / 1000)) as low_bottom, max(gain) filter (k = ceil((n - 1) * 975 / 1000)) as high_top, max(taken) filter (k = ceil((n - 1) * 975 / 1000)) as high_bottom from v group by 1, 2""",
)
def b06(spark, d):
    x, days = _panel(spark, d)
    draws = cb.resampled(x, ["symbol", "variant"], "day", ["gain", "taken"], days, _REPS, _BLOCK)
    return cb.exact_endpoints(draws, ["symbol", "variant"], "gain", "taken")
