"""Bar anatomy, directional features, first touches, regimes and bootstraps of whole blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import segment

_SMALLEST = 1e-12


def anatomy() -> dict[str, Column]:
    """Wick ratios of a bar; a bar without range has the smallest one."""
    size = F.greatest(F.col("high") - F.col("low"), F.lit(_SMALLEST))
    return {
        "upper_wick": F.greatest(F.lit(0.0), (F.col("high") - F.greatest("open", "close")) / size),
        "lower_wick": F.greatest(F.lit(0.0), (F.least("open", "close") - F.col("low")) / size),
    }


def decision_clock(open_ms: Column, step_ms: int, grace_ms: int = 2001) -> dict[str, Column]:
    """Whether a bar opens on the grid, its inclusive close, and the cut-off ``grace_ms`` later."""
    return {"aligned": F.pmod(open_ms, F.lit(step_ms)) == 0, "close_ms": open_ms + (step_ms - 1), "cutoff_ms": open_ms + (step_ms - 1 + grace_ms)}


def ratio_micros(part: Column, whole: Column) -> Column:
    """Millionths of a ratio of whole numbers, halves away from zero, without doubles."""
    twice = (2 * F.abs(part) * F.lit(1_000_000) + F.abs(whole)).cast("decimal(38,0)")
    size = F.floor(twice / (2 * F.abs(whole)).cast("decimal(38,0)")).cast("long")
    return F.when(whole != 0, F.signum(part.cast("double")).cast("long") * F.signum(whole.cast("double")).cast("long") * size)


def attempt_alpha(attempt: Column, alpha: float = 0.025) -> Column:
    """What the n-th of a sequence of attempts may spend: half of the one before."""
    return F.lit(alpha) * F.pow(F.lit(2.0), 1 - attempt)


def sized(quote: float, price: Column, steps_per_unit: int) -> Column:
    """Quantity for a fixed quote amount, floored to the step."""
    return F.when(price > 0, F.floor(F.lit(quote) / price * steps_per_unit) / steps_per_unit)


def tick_aligned(price: Column, scale: int, tick: int) -> Column:
    """Whether a price is a whole number of ticks, both in units of 1 / ``scale``."""
    return F.round(price * scale).cast("long") % tick == 0


def slopes(lag: int = 3) -> dict[str, Column]:
    """Slope of EMA 20 over ``lag`` bars and distance of the close from it, in ATR."""
    atr = F.when(F.col("atr") > 0, F.col("atr"))
    return {"ema20_slope_atr": (F.col("ema20") - F.lag("ema20", lag).over(segment())) / atr, "ema20_distance_atr": (F.col("close") - F.col("ema20")) / atr}


def divergences(lookback: int = 30, move: float = 0.001, rsi_points: float = 2.0) -> dict[str, Column]:
    """Price makes a new extreme in the second half of the look-back and RSI does not; of equal extremes the first counts."""
    half = lookback // 2
    first, second = segment().rowsBetween(1 - lookback, -half), segment().rowsBetween(1 - half, 0)
    whole = F.count(F.lit(1)).over(segment().rowsBetween(1 - lookback, 0)) == lookback

    def top(frame, value: Column) -> Column:
        # a place in the segment breaks ties; the latest has the least
        return F.max(F.struct(value.alias("v"), (-F.col("open_time_ms")).alias("place"), F.col("rsi").alias("rsi"))).over(frame)

    h1, h2, l1, l2 = top(first, F.col("high")), top(second, F.col("high")), top(first, -F.col("low")), top(second, -F.col("low"))
    bearish = (h2["v"] > h1["v"] * (1 + move)) & (h2["rsi"] < h1["rsi"] - rsi_points)
    bullish = (l2["v"] > l1["v"] * (1 - move)) & (l2["rsi"] > l1["rsi"] + rsi_points)
    return {"bearish_divergence": F.coalesce(whole & bearish, F.lit(False)), "bullish_divergence": F.coalesce(whole & bullish, F.lit(False))}


def horizon_outcome(bars: DataFrame, step_ms: int, horizon_ms: int) -> DataFrame:
    """Highest, lowest and last return of the bars that open after a bar's close and close within the horizon."""
    w = Window.partitionBy("symbol").orderBy("open_time_ms").rangeBetween(step_ms, horizon_ms)
    back = lambda c: F.col(c) / F.col("close") - 1
    x = bars.withColumns({"_high": F.max("high").over(w), "_low": F.min("low").over(w), "_last": F.last("close").over(w)})
    return x.where("_last is not null").select("symbol", "open_time_ms", back("_high").alias("highest"), back("_low").alias("lowest"), back("_last").alias("final"))


def first_touch(entries: DataFrame, bars: DataFrame, step_ms: int, most: int) -> DataFrame:
    """Which of a target one risk away and the invalidation a path touches first, within ``most`` bars.

    ``entries`` has symbol, open_time_ms, direction (1 or -1), entry and
    invalidation; its path are the next ``most`` bars.  An open beyond either
    price decides at the open; both touched inside one bar is a collision.
    Adds status and at_ms.  Bars meet entries on buckets of ``most`` bars.
    """
    d = F.col("direction")
    target = 2 * F.col("entry") - F.col("invalidation")
    valid = F.coalesce((d * (F.col("entry") - F.col("invalidation")) > 0) & (F.col("invalidation") > 0) & (target > 0), F.lit(False))
    e = entries.withColumns({"_target": target, "_valid": valid, "_id": F.struct("symbol", "open_time_ms", "direction", "entry", "invalidation")})
    width = step_ms * most
    bucket = F.floor(F.col("open_time_ms") / width)
    asked = e.where("_valid").select("_id", "symbol", F.col("open_time_ms").alias("_from"), "direction", "invalidation", "_target", F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    path = bars.select("symbol", F.col("open_time_ms").alias("_open_ms"), F.col("open").alias("_open"), F.col("high").alias("_high"), F.col("low").alias("_low"), bucket.alias("_bucket"))
    x = asked.join(path, ["symbol", "_bucket"]).where((F.col("_open_ms") > F.col("_from")) & (F.col("_open_ms") <= F.col("_from") + width))
    reached = lambda price: d * (F.col(price) - F.col("_target")) >= 0
    failed = lambda price: d * (F.col(price) - F.col("invalidation")) <= 0
    best, worst = F.when(d > 0, F.col("_high")).otherwise(F.col("_low")), F.when(d > 0, F.col("_low")).otherwise(F.col("_high"))
    x = x.withColumns({"_best": best, "_worst": worst})
    status = F.when(reached("_open"), "TARGET_FIRST").when(failed("_open"), "INVALIDATION_FIRST").when(reached("_best") & failed("_worst"), "COLLISION").when(reached("_best"), "TARGET_FIRST").when(failed("_worst"), "INVALIDATION_FIRST")
    at_open = reached("_open") | failed("_open")
    x = x.withColumns({"_status": status, "_at": F.when(at_open, F.col("_open_ms")).otherwise(F.col("_open_ms") + (step_ms - 1))})
    found = x.groupBy("_id").agg(F.min_by(F.struct("_status", "_at"), F.when(F.col("_status").isNotNull(), F.col("_open_ms"))).alias("_first"), (F.max("_open_ms") + (step_ms - 1)).alias("_end"))
    out = e.join(found, "_id", "left")
    status = F.when(~F.col("_valid"), "INVALID_INVALIDATION").otherwise(F.coalesce("_first._status", F.lit("TIMEOUT")))
    return out.select(*entries.columns, status.alias("status"), F.when(F.col("_valid"), F.coalesce("_first._at", "_end")).alias("at_ms"))


def regime(breadth: Column, trend: Column) -> Column:
    return F.when((trend == "bullish") & (breadth >= 0.55), "risk_on").when((trend == "bearish") & (breadth <= 0.45), "risk_off").otherwise("neutral")


def stack_trend(price: Column, fast: Column, slow: Column) -> Column:
    """bullish or bearish where price and averages are stacked, else neutral."""
    return F.when((price > fast) & (fast > slow), "bullish").when((price < fast) & (fast < slow), "bearish").otherwise("neutral")


def population_beta(value: str, market: str, least: float = 0.25, most: float = 2.5) -> Column:
    """Slope on the market within bounds; null without spread of the market."""
    spread = F.var_pop(market)
    return F.when(spread > 0, F.greatest(F.lit(least), F.least(F.lit(most), F.covar_pop(value, market) / spread)))


def whole_block_means(blocks: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """(key, rep, mean): means over as many whole blocks as there are, drawn with replacement.

    ``blocks`` has key, place (0, 1, ...), s (sum) and c (count) of each block.
    Draws are digests of seed, rep and draw, so the result does not depend on tasks.
    """
    sizes = blocks.groupBy(key).agg(F.count("*").alias("_n"))
    draws = sizes.select(key, "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select(key, "_n", "rep", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_draw"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_draw").cast("string")))
    draws = draws.withColumn("place", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n"))
    return draws.join(blocks, [key, "place"]).groupBy(key, "rep").agg((F.sum("s") / F.sum("c")).alias("mean"))


def order_statistics(means: DataFrame, key: str, q: float = 0.025) -> DataFrame:
    """(key, low, high) at ranks floor(q (n - 1)) and ceil((1 - q)(n - 1)) of the means."""
    w = Window.partitionBy(key)
    n = F.col("_n") - 1
    x = means.withColumns({"_k": F.row_number().over(w.orderBy("mean")) - 1, "_n": F.count("*").over(w)})
    return x.groupBy(key).agg(F.max(F.when(F.col("_k") == F.floor(n * q), F.col("mean"))).alias("low"), F.max(F.when(F.col("_k") == F.ceil(n * (1 - q)), F.col("mean"))).alias("high"))


def basic_bound(means: DataFrame, points: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """(key, point, lower, p_value): the one-sided basic bound, and the share of null-centred draws that reach the point."""
    x = means.join(points, key)
    lower = 2 * F.first("point") - F.percentile("mean", F.lit(1 - alpha))
    return x.groupBy(key).agg(F.first("point").alias("point"), lower.alias("lower"), ((F.count_if(F.col("mean") - F.col("point") >= F.col("point")) + 1) / (F.count("*") + 1)).alias("p_value"))


def first_of_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, and how many there were as ``n_rows``."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "n_rows": F.count("*").over(w)}).where("_k = 1").drop("_k")


def conflicts(rows: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, n, kinds, state): one content once is single, one content again duplicate, several are a conflict."""
    x = rows.groupBy(*keys, *content).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
    return x.withColumn("state", F.when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("single"))


def delivery_class(target: Column, delivered: Column, now: Column, grace_ms: int) -> Column:
    """on_time up to the target, late within the grace, pending before it has passed, else missing."""
    return F.when(delivered <= target, "on_time").when(delivered <= target + grace_ms, "late").when(delivered.isNull() & (now <= target + grace_ms), "pending").otherwise("missing")


def admission(event_ms: Column, receipt_ms: Column, cutoff_ms: Column) -> Column:
    """Why a row is not admitted at the cut-off; null where it is."""
    return F.when(event_ms > cutoff_ms, "EVENT_AFTER_CUTOFF").when(receipt_ms > cutoff_ms, "RECEIPT_AFTER_CUTOFF").when(receipt_ms < event_ms, "RECEIPT_PRECEDES_EVENT")


def actionability_gate(on_time: Column, total: Column, pending: Column) -> Column:
    """PASS from 99 of 100 on time; nothing to judge, or anything pending, is inconclusive."""
    return F.when((total == 0) | (pending > 0), "INCONCLUSIVE").when(on_time * 100 >= total * 99, "PASS").otherwise("FAIL")


def book_tops(levels: DataFrame, by: list[str], band: float = 0.001) -> DataFrame:
    """Best bid and ask, mid, spread in basis points, and quote depth of each side within ``band`` of the mid."""
    bid, ask = F.max(F.when(F.col("side") == "bid", F.col("price"))), F.min(F.when(F.col("side") == "ask", F.col("price")))
    top = levels.groupBy(*by).agg(bid.alias("bid"), ask.alias("ask")).where("bid < ask").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    x = levels.join(top, by)
    inside = lambda side, near: F.coalesce(F.sum(F.when((F.col("side") == side) & near, F.col("price") * F.col("qty"))), F.lit(0.0))
    out = x.groupBy(*by, "bid", "ask", "mid").agg(inside("bid", F.col("price") >= F.col("mid") * (1 - band)).alias("bid_depth"), inside("ask", F.col("price") <= F.col("mid") * (1 + band)).alias("ask_depth"))
    return out.withColumn("spread_bps", (F.col("ask") - F.col("bid")) / F.col("mid") * 10_000)


def bridge(snapshots: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Snapshots against the update ranges received after them, one row each.

    ``snapshots`` has seq and last_id; ``ranges`` seq, first_id and final_id and
    are those buffered for the snapshot named by ``by``.  Ranges that end at or
    before last_id are discarded; the first other one in order of seq must begin
    at last_id + 1 or before.  waiting: there is none yet.
    """
    x = ranges.join(snapshots.select(*by, "last_id"), by, "right")
    gone = F.col("final_id") <= F.col("last_id")
    found = x.groupBy(*by, "last_id").agg(F.count_if(gone).alias("discarded"), F.min_by("first_id", F.when(~gone, F.col("seq"))).alias("next_id"))
    state = F.when(F.col("next_id").isNull(), "waiting").when(F.col("next_id") <= F.col("last_id") + 1, "accepted").otherwise("stale")
    return found.select(*by, state.alias("state"), "discarded")
