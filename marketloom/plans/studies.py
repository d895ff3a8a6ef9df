"""Registered queries of audits, evidence, calibration and verdicts; they join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, evidence, metrics, series, walkforward
from . import market
from .market import _BREAKS, _HOURS, _SEG, _breaks, _hours, _over, _register, r, rounded
from .views import DAY_MS, FUNDING, HOUR_MS, TICKS, candles, candles_sql, epoch_ms, funding, table, ticks


# ---- audits ----
@_register("p02_grid_violations", f"with o as (select o_orderpriority, epoch_ms(cast(o_orderdate as timestamp)) as t from orders), g as (select o_orderpriority, t - lag(t) over (partition by o_orderpriority order by t) as g from o) select o_orderpriority, count(*) as n, count(*) filter (g <= 0) as unordered, count(*) filter (g % {7 * DAY_MS} <> 0) as off_grid from g group by 1")
def p02(spark, d):
    return audit.grid_violations(table(spark, d, "orders").select("o_orderpriority", epoch_ms("o_orderdate").alias("t")), "o_orderpriority", "t", 7 * DAY_MS)


@_register("p09_newest_rows", "with k as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) select user_id, event_id, k from k where k <= 3")
def p09(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 3")


@_register("p11_cursor_conflicts", "with c as (select l_partkey, epoch_ms(cast(l_shipdate as timestamp)) as cursor_ms, count(distinct (l_quantity, l_extendedprice)) as k from lineitem group by 1, 2) select l_partkey, count(*) as cursors, count(*) filter (k > 1) as conflicts, max(cursor_ms) as latest from c group by 1")
def p11(spark, d):
    x = table(spark, d, "lineitem").select("l_partkey", epoch_ms("l_shipdate").alias("cursor_ms"), "l_quantity", "l_extendedprice")
    return audit.cursor_conflicts(x, "l_partkey", "cursor_ms", ["l_quantity", "l_extendedprice"])


@_register("p13_retained_keys", "select o_orderpriority, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000) group by 1")
def p13(spark, d):
    allowed = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(allowed, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@_register("p14_schedule_coverage", f"with {FUNDING}, g as (select *, funding_time_ms - lag(funding_time_ms) over (partition by symbol order by funding_time_ms) as g from funding) select symbol, count(*) as n, min(funding_time_ms) as first_ms, max(funding_time_ms) as last_ms, count(*) filter (funding_time_ms % {8 * HOUR_MS} <> 0) as off_grid, count(*) filter (g <> {8 * HOUR_MS}) as wrong_spacing from g group by 1")
def p14(spark, d):
    return audit.schedule_coverage(funding(spark, d), "symbol", "funding_time_ms", 8 * HOUR_MS)


#: Half-open ranges of dates: development, validation, retrospective.
SPLITS = [("development", "1990-01-01", "1995-01-01"), ("validation", "1995-01-01", "1997-01-01"), ("retrospective", "1997-01-01", "2100-01-01")]


@_register("p15_splits", f"with s(split, a, b) as (values {', '.join(f'''('{n}', timestamp '{a}', timestamp '{b}')''' for n, a, b in SPLITS)}) select split, l_returnflag, count(*) as n from lineitem join s on cast(l_shipdate as timestamp) >= a and cast(l_shipdate as timestamp) < b group by 1, 2")
def p15(spark, d):
    t = F.col("l_shipdate").cast("timestamp")
    split = F.coalesce(*(F.when((t >= F.lit(a).cast("timestamp")) & (t < F.lit(b).cast("timestamp")), n) for n, a, b in SPLITS))
    return table(spark, d, "lineitem").select(split.alias("split"), "l_returnflag").where("split is not null").groupBy("split", "l_returnflag").agg(F.count("*").alias("n"))


#: Lines that one task of the integrity audit joins.
_LINES = 500_000


@_register("p16_integrity", "with x as (select l_orderkey, l_linenumber, l_shipdate, l_discount, o_orderkey, o_orderdate, count(*) over (partition by l_orderkey, l_linenumber) as c from lineitem left join orders on l_orderkey = o_orderkey), f as (select 'duplicate_id' as rule, l_orderkey, l_linenumber from x where c > 1 union all select 'orphan', l_orderkey, l_linenumber from x where o_orderkey is null union all select 'shipped_before_order', l_orderkey, l_linenumber from x where l_shipdate < o_orderdate union all select 'discount_range', l_orderkey, l_linenumber from x where l_discount < 0 or l_discount > 0.1::double) select rule, l_orderkey, l_linenumber, count(*) as n from f group by 1, 2, 3")
def p16(spark, d):
    lines = table(spark, d, "lineitem")
    n = lines.count() // _LINES + 1  # as many tasks as lines need: sorts of a task stay small at any size
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey")
    x = lines.repartition(n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {"orphan": F.col("o_orderkey").isNull(), "shipped_before_order": F.col("l_shipdate") < F.col("o_orderdate"), "discount_range": (F.col("l_discount") < 0) | (F.col("l_discount") > 0.1)}
    return audit.failures_by_key(x, rules, ["l_orderkey", "l_linenumber"], "duplicate_id")


# ---- evidence on series ----
def _signed(n: int) -> str:
    over = _over(1 - n, 0)
    return f"case when rn >= {n} and sum(quote_volume) {over} > 0 then sum(2 * taker_quote - quote_volume) {over} / sum(quote_volume) {over} end"


@_register("w17_taker_delta", f"with {_SEG} select symbol, open_time_ms, {r(_signed(3))} as d3, {r(_signed(12))} as d12 from t")
def w17(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS)
    return rounded(x.select("symbol", "open_time_ms", evidence.taker_delta(3).alias("d3"), evidence.taker_delta(12).alias("d12")))


@_register("w30_realized_volatility", f"with {_SEG}, l as (select *, power(ln(close / lag(close) over (partition by symbol, seg order by open_time_ms)), 2) as r2 from t) select symbol, open_time_ms, {r(f'case when count(r2) {_over(-575, 0)} = 576 then 10000 * sqrt(sum(r2) {_over(-575, 0)}) end', 4)} as volatility_bps from l")
def w30(spark, d):
    x = evidence.realized_volatility(series.with_segments(candles(spark, d), DAY_MS), 576)
    return rounded(x.select("symbol", "open_time_ms", "volatility_bps"), 4)


@_register("w33_prior_ecdf", f"with {_SEG}, c as (select a.symbol, a.open_time_ms, count(*) as n, count(*) filter (b.close <= a.close) as le from t a join t b on a.symbol = b.symbol and a.seg = b.seg and b.rn between a.rn - 120 and a.rn - 1 group by 1, 2) select symbol, open_time_ms, {r('le / 120.0::double')} as ecdf from c where n = 120")
def w33(spark, d):
    x = series.with_segments(candles(spark, d), DAY_MS).select("symbol", "open_time_ms", evidence.prior_ecdf("close", 120).alias("ecdf"))
    return rounded(x.where("ecdf is not null"))


@_register("w34_robust_z", f"""with {_SEG}, p as (select *, list(volume) {_over(-60, -1)} as past from t), m as (select *, list_aggregate(past, 'quantile_cont', 0.5) as med from p), a as (select *, list_aggregate(list_transform(past, lambda v: abs(v - med)), 'quantile_cont', 0.5) as mad from m)
 select symbol, open_time_ms, case when rn <= 60 then 'WARMUP' when mad <= 0 then 'ZERO_SCALE' else 'OK' end as z_status, {r('case when rn > 60 and mad > 0 then (volume - med) / (mad * 1.4826::double) end')} as z from a""")
def w34(spark, d):
    x = evidence.robust_z(series.with_segments(candles(spark, d), DAY_MS), "volume", 60)
    return rounded(x.select("symbol", "open_time_ms", "z_status", "z"))


@_register("w40_duration_quantile", f"with {TICKS}, d as (select symbol, price, lead(ts_ms) over (partition by symbol order by ts_ms) - ts_ms as d from ticks), e as (select symbol, price, sum(d) as d from d where d > 0 group by 1, 2), c as (select *, sum(d) over (partition by symbol order by price) as upto, sum(d) over (partition by symbol) as whole from e) select symbol, min(price) as quantile from c where upto >= whole * 0.95::double group by 1")
def w40(spark, d):
    return evidence.duration_quantile(ticks(spark, d), "symbol", "ts_ms", "price", 0.95)


# ---- metrics ----
@_register("a06_cost_decomposition", f"with {_BREAKS} select symbol, count(*) as n, {r('sum(gross_return)')} as gross, {r('sum(gross_return - ex)')} as slippage, {r('sum(fee_return)')} as fees, {r('sum(net_return)')} as net, count(*) filter (gross_return > 0 and net_return <= 0) as turned from z group by 1")
def a06(spark, d):
    slip = F.col("gross_return") - F.col("fee_return") - F.col("net_return")
    turned = F.count_if((F.col("gross_return") > 0) & (F.col("net_return") <= 0))
    return rounded(_breaks(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("gross_return").alias("gross"), F.sum(slip).alias("slippage"), F.sum("fee_return").alias("fees"), F.sum("net_return").alias("net"), turned.alias("turned")))


_HORIZONS = (3, 12, 72)
_HORIZON_SQL = " union all ".join(f"select symbol, {h} as horizon, lead(open_time_ms, {h}) over k = open_time_ms + {h * DAY_MS} as ok, lead(close, {h}) over k / lead(open, 1) over k - 1 as ret from t window k as (partition by symbol order by open_time_ms)" for h in _HORIZONS)


@_register("a07_opportunities", f"with {_SEG}, h as ({_HORIZON_SQL}), l as (select *, coalesce(ok, false) as known from h) select symbol, horizon, count(*) as n, count(*) filter (known) as labelled, count(*) filter (known and ret > 0.0005::double) as up, count(*) filter (known and ret < -0.0005::double) as down, {r('avg(case when known then ret end)')} as mean_return from l group by 1, 2")
def a07(spark, d):
    w = Window.partitionBy("symbol").orderBy("open_time_ms")
    known = lambda h: F.coalesce(F.lead("open_time_ms", h).over(w) == F.col("open_time_ms") + h * DAY_MS, F.lit(False))
    each = [F.struct(F.lit(h).alias("horizon"), F.when(known(h), F.lead("close", h).over(w) / F.lead("open", 1).over(w) - 1).alias("ret")) for h in _HORIZONS]
    x = candles(spark, d).select("symbol", F.array(*each).alias("x")).select("symbol", F.explode("x").alias("x")).select("symbol", "x.*")
    return rounded(x.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.count("ret").alias("labelled"), F.count_if(F.col("ret") > 0.0005).alias("up"), F.count_if(F.col("ret") < -0.0005).alias("down"), F.avg("ret").alias("mean_return")))


@_register("a13_concentration", f"with {_BREAKS}, nets as (select direction, symbol, sum(net_return) as s from z group by 1, 2) select direction, count(*) as assets, count(*) filter (s > 0) as positive, {r('max(abs(s)) / sum(abs(s))')} as largest_share from nets group by 1")
def a13(spark, d):
    s = _breaks(spark, d).groupBy("direction", "symbol").agg(F.sum("net_return").alias("s"))
    return rounded(s.groupBy("direction").agg(F.count("*").alias("assets"), F.count_if(F.col("s") > 0).alias("positive"), F.try_divide(F.max(F.abs("s")), F.sum(F.abs("s"))).alias("largest_share")))


_HIT = "case when net_return > 0.0005::double then 'HIT' when net_return < -0.0005::double then 'MISS' else 'AMBIGUOUS' end"


@_register("a15_path_status", f"with {_BREAKS}, h as (select symbol, {_HIT} as hit from z) select symbol, count(*) filter (hit = 'HIT') as hits, count(*) filter (hit = 'MISS') as misses, count(*) filter (hit = 'AMBIGUOUS') as ambiguous from h group by 1")
def a15(spark, d):
    x = _breaks(spark, d).withColumn("hit", scalars.hit_label(F.col("net_return"), 5)).groupBy("symbol").pivot("hit", ["HIT", "MISS", "AMBIGUOUS"]).agg(F.count(F.lit(1)))
    return x.fillna(0).toDF("symbol", "hits", "misses", "ambiguous")


@_register("a17_direction_accuracy", f"with {_BREAKS}, h as (select symbol, direction, {_HIT} as hit from z) select symbol, direction, count(*) as n, {r('''count(*) filter (hit = 'HIT') / count(*)''')} as strict, {r('''count(*) filter (hit = 'HIT') / nullif(count(*) filter (hit <> 'AMBIGUOUS'), 0)''')} as resolved, {r('''count(*) filter (hit <> 'AMBIGUOUS') / count(*)''')} as coverage from h group by 1, 2")
def a17(spark, d):
    x = _breaks(spark, d).withColumn("hit", scalars.hit_label(F.col("net_return"), 5))
    hits, known, n = F.count_if(F.col("hit") == "HIT"), F.count_if(F.col("hit") != "AMBIGUOUS"), F.count("*")
    return rounded(x.groupBy("symbol", "direction").agg(n.alias("n"), (hits / n).alias("strict"), F.try_divide(hits, known).alias("resolved"), (known / n).alias("coverage")))


@_register("a19_score_gradient", f"with {_BREAKS}, binned as (select symbol, net_return, floor((row_number() over (partition by symbol order by round(mfe - mae, 9), open_time_ms) * 4 - 1) / count(*) over (partition by symbol)) as q from z) select symbol, cast(q as integer) as quartile, count(*) as n, {r('avg(net_return)')} as mean_net, cast(sum(round(net_return * 1000000)) as bigint) as net_micros from binned group by 1, 2")
def a19(spark, d):
    x = _breaks(spark, d).withColumn("range", F.round(F.col("mfe") - F.col("mae"), 9))
    x = metrics.equal_count_bins(x.select("symbol", "range", "open_time_ms", "net_return"), ["symbol"], ["range", "open_time_ms"], 4, "quartile")
    return rounded(x.groupBy("symbol", "quartile").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean_net"), F.sum(F.round(F.col("net_return") * 1000000).cast("long")).alias("net_micros")))


_CRITERIA = {"enough_trades": ("n", ">=", 30), "positive_mean": ("mean", ">=", 0), "win_rate": ("win_rate", ">=", 0.5), "worst_trade": ("worst", ">=", -0.5)}


@_register("a23_verdicts", f"with {_BREAKS}, m as (select symbol, count(*) as n, avg(net_return) as mean, avg(case when net_return > 0 then 1.0::double else 0 end) as win_rate, min(net_return) as worst from z group by 1), v as (" + " union all ".join(f"select symbol, '{n}' as criterion, cast({c} as double) as value, '{op}' as op, cast({t} as double) as threshold from m" for n, (c, op, t) in _CRITERIA.items()) + f") select symbol, criterion, {r('value')} as value, op, threshold, coalesce(value >= threshold, false) as passed from v")
def a23(spark, d):
    m = _breaks(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.min("net_return").alias("worst"))
    return rounded(evidence.verdicts(m, ["symbol"], _CRITERIA))


# ---- inference ----
_REPS = 10


@_register("b11_matched_random", f"with w as (select event_type, count(*) filter (value > 450) as want from events group by 1), x as (select x.rep, event_type, value, want, row_number() over (partition by x.rep, event_type order by cast(('0x' || substr(md5('11|' || x.rep || '|' || event_id), 1, 8)) as bigint), event_id) as place from events join w using (event_type), range({_REPS}) as x(rep)) select cast(rep as integer) as rep, count(*) as picked, {r('avg(value)', 4)} as random_mean from x where place <= want group by 1")
def b11(spark, d):
    x = table(spark, d, "events").select("event_type", "event_id", "value", (F.col("value") > 450).alias("chosen"))
    return rounded(evidence.matched_random(x, "event_type", "event_id", "chosen", "value", _REPS), 4)


@_register("b12_percentile_composite", f"with {candles_sql()}, u as (unpivot (select symbol, open_time_ms, open_time_ms < 820454400000 as dev, volume as volume, cast(trade_count as double) as trades, high - low as spread from candles) on volume, trades, spread into name feature value value), k as (select *, (2 * sum(dev::int) over (partition by feature order by value range between unbounded preceding and current row) - sum(dev::int) over (partition by feature, value)) / (2.0::double * nullif(sum(dev::int) over (partition by feature), 0)) as p from u) select symbol, open_time_ms, {r('avg(p)')} as composite from k group by 1, 2")
def b12(spark, d):
    c = candles(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in {"volume": F.col("volume"), "trades": F.col("trade_count"), "spread": F.col("high") - F.col("low")}.items()))).alias("x")
    x = c.select("symbol", "open_time_ms", (F.col("open_time_ms") < 820454400000).alias("dev"), each).select("symbol", "open_time_ms", "dev", "x.*")
    x = x.withColumn("p", evidence.development_midrank(x, "feature", "value", "dev"))
    return rounded(x.groupBy("symbol", "open_time_ms").agg(F.avg("p").alias("composite")))


_TEMPERATURES, _INTERCEPTS = [0.5, 1.0, 2.0, 4.0], [-1.0, 0.0, 1.0, 2.0]
_SCORED = "s as (select doc_id, lang, quality, ln(1.0::double + n_chars) - 6 as logit from documents join labels using (doc_id))"
_P = lambda x: f"greatest(1e-12::double, least(1 - 1e-12::double, 1 / (1 + exp(-({x})))))"


def _scored(spark, d) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", "lang", "quality", (F.log(F.lit(1.0) + F.col("n_chars")) - 6).alias("logit"))


@_register("b14_sigmoid_fit", f"with {_SCORED}, g as (select lang, temperature, intercept, round(avg(-ln(case when quality = 1 then {_P('logit / temperature + intercept')} else 1 - {_P('logit / temperature + intercept')} end)), 9) as loss from s, unnest({_TEMPERATURES}::double[]) as t(temperature), unnest({_INTERCEPTS}::double[]) as i(intercept) group by 1, 2, 3), k as (select *, row_number() over (partition by lang order by loss, temperature, intercept) as k from g) select lang, temperature, intercept, {r('loss')} as loss from k where k = 1")
def b14(spark, d):
    return rounded(evidence.fit_sigmoid(_scored(spark, d), ["lang"], "logit", "quality", _TEMPERATURES, _INTERCEPTS))


@_register("b15_calibration", f"with {_SCORED}, p as (select *, {_P('logit')} as p from s), b as (select *, floor((row_number() over (partition by lang order by p, doc_id) * 10 - 1) / count(*) over (partition by lang)) as bin from p), e as (select lang, bin, count(*) as n, sum(-ln(case when quality = 1 then p else 1 - p end)) as l, sum(power(p - quality, 2)) as s, abs(sum(p) - sum(quality)) as e from b group by 1, 2) select lang, cast(sum(n) as bigint) as n, {r('sum(l) / sum(n)')} as loss, {r('sum(s) / sum(n)')} as brier, {r('sum(e) / sum(n)')} as ece from e group by 1")
def b15(spark, d):
    x = _scored(spark, d).withColumn("p", evidence.probability(F.col("logit")))
    return rounded(evidence.calibration(x, ["lang"], "p", "quality", ["doc_id"]))


@_register("b18_train_moments", f"with {candles_sql()}, e as (select min(open_time_ms) as a, max(open_time_ms) as b from candles), f as (select a, unnest(range(0, (b - a - {180 * DAY_MS}) // {30 * DAY_MS} + 1)) as fold from e), s as (select fold, a + {180 * DAY_MS} + fold * {30 * DAY_MS} as start from f) select cast(fold as integer) as fold, {r('avg(volume)', 4)} as mean, {r('case when stddev_pop(volume) > 0 then stddev_pop(volume) else 1 end', 4)} as scale from s, candles where open_time_ms < start - {DAY_MS // 4} group by 1")
def b18(spark, d):
    x = candles(spark, d).select("open_time_ms", "volume")
    schedule = walkforward.Schedule.of(x, "open_time_ms", 180 * DAY_MS, 30 * DAY_MS, DAY_MS // 4)
    return rounded(walkforward.train_moments(x, "volume", "open_time_ms", schedule), 4)


@_register("b20_correlation", f"with {candles_sql()} select symbol, count(*) as n, {r('corr(volume, trade_count)')} as pearson from candles group by 1")
def b20(spark, d):
    return rounded(candles(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.corr("volume", F.col("trade_count").cast("double")).alias("pearson")))


# ---- sets, coverage and clocks ----
@_register("o03_union", "select 'order' as panel, o_orderkey as id, o_totalprice as amount from orders union all select 'line', l_orderkey, l_extendedprice from lineitem")
def o03(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("panel"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return a.unionByName(table(spark, d, "lineitem").select(F.lit("line").alias("panel"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount")))


@_register("o05_intersection", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def o05(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@_register("c06_coverage_time", f"with {TICKS}, d as (select symbol, case when is_buyer_maker then 'valid' else 'waiting' end as category, lead(ts_ms) over (partition by symbol order by ts_ms) - ts_ms as d from ticks), p as (select symbol, category, least(d, 600000) as ms from d where d > 0 union all select symbol, 'stale', d - 600000 from d where d > 600000) select symbol, category, cast(sum(ms) as bigint) as covered_ms, max(ms) as longest_ms from p group by 1, 2")
def c06(spark, d):
    x = ticks(spark, d).withColumn("category", F.when(F.col("is_buyer_maker"), "valid").otherwise("waiting"))
    return audit.coverage_time(x, "symbol", "ts_ms", "category", 600_000, ("agg_id",))


@_register("c08_clock_residuals", f"with {TICKS}, m as (select *, ts_ms * 1000000 + (agg_id % 300) * 500000 as mono from ticks), o as (select symbol, abs((ts_ms - lag(ts_ms) over k) * 1000000 - (mono - lag(mono) over k)) as o from m window k as (partition by symbol order by agg_id)) select symbol, case when o <= 2000000 then 'steady' when o <= 100000000 then 'slewed' else 'stepped' end as class, count(*) as n from o where o is not null group by 1, 2")
def c08(spark, d):
    x = ticks(spark, d).withColumn("mono", F.col("ts_ms") * 1000000 + (F.col("agg_id") % 300) * 500000)
    return audit.clock_residuals(x, "symbol", ["agg_id"], "ts_ms", "mono")


@_register("c10_census", f"with {TICKS} select 'stream' as kind, symbol as key, count(*) as n, min(ts_ms) as first, max(ts_ms) as last from ticks group by 2 union all select 'role', cast(is_buyer_maker as varchar), count(*), min(ts_ms), max(ts_ms) from ticks group by 2 union all select 'lot', cast(cast(qty as bigint) as varchar), count(*), min(ts_ms), max(ts_ms) from ticks group by 2")
def c10(spark, d):
    return audit.census(ticks(spark, d), {"stream": F.col("symbol"), "role": F.col("is_buyer_maker"), "lot": F.col("qty").cast("long")}, "ts_ms")


@_register("c11_record_loss", "select event_type, max(event_id) - min(event_id) + 1 - count(distinct event_id) as lost, count(*) - count(distinct event_id) as repeated from events group by 1")
def c11(spark, d):
    each = table(spark, d, "events").groupBy("event_type", "event_id").agg(F.count("*").alias("c"))
    return each.groupBy("event_type").agg((F.max("event_id") - F.min("event_id") + 1 - F.count("*")).alias("lost"), (F.sum("c") - F.count("*")).alias("repeated"))


@_register("c12_missing_slots", f"with {_HOURS}, e as (select symbol, min(open_time_ms) as a, max(open_time_ms) as b from hours group by 1), g as (select symbol, unnest(range(a, b, {HOUR_MS})) as open_time_ms from e) select symbol, open_time_ms from g anti join hours using (symbol, open_time_ms)")
def c12(spark, d):
    return audit.missing_slots(_hours(spark, d), "symbol", "open_time_ms", HOUR_MS)


@_register("c16_transitions", "with l as (select lag(event_type) over (partition by user_id order by ts, event_id) as before, event_type as after from events) select before, after, count(*) as n, before <> after as allowed from l where before is not null group by 1, 2")
def c16(spark, d):
    return audit.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("allowed", F.col("before") != F.col("after"))


def queries() -> dict[str, market.Query]:
    """All market queries, those of this module included."""
    return market.queries()


def oracle_sql() -> dict[str, str]:
    return market.oracle_sql()
