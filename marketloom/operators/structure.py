"""Chart structure: qualified pivots, swing state, trend lines and pullbacks, causal at every bar.

A pivot is carried to the bar at which it becomes known, so that "the last two
known within 100 bars" is the latest one in a fixed frame and the one it points
to.  Extremes and lists since a pivot are running ones over the bars that share
it, never a join of bars with the bars of a frame.  Nothing looks back more
than HALO bars: a long series is cut in chunks that begin so much early, and
each chunk is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEFT, RIGHT = 2, 2
TTL_BARS = 100
MIN_PROMINENCE_ATR = 0.75
EQUALITY_ATR = 0.10
MIN_IMPULSE_ATR = 2.0
MIN_DEPTH, MAX_DEPTH, INVALID_DEPTH = 0.20, 0.60, 0.75
MAX_PULLBACK_BARS = 12
CONFLUENCE_ATR = 0.25
BREAK_BUFFER_ATR = 0.25
#: Bars that a chunk begins early: a pivot of TTL_BARS ago, the bars around it, and as much again for the pivot it points to.
HALO = 2 * TTL_BARS + LEFT + RIGHT + 4
CHUNK_BARS = 50_000


def chunked(bars: DataFrame, step_ms: int, chunk_bars: int = CHUNK_BARS, halo: int = HALO) -> DataFrame:
    """``bars`` with ``i`` (number of the bar in time), ``chunk`` and ``own``; the last ``halo`` bars of a chunk also lead the next one, not owned."""
    if not 0 < halo <= chunk_bars:
        raise ValueError("halo must be between 1 and chunk_bars")
    i = F.floor(F.col("open_time_ms") / step_ms)
    chunk = F.floor(F.col("i") / chunk_bars)
    copies = F.when(F.pmod("i", F.lit(chunk_bars)) >= chunk_bars - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = bars.withColumn("i", i).withColumn("_more", F.explode(copies))
    return x.withColumns({"chunk": chunk + F.col("_more"), "own": F.col("_more") == 0}).drop("_more")


def _median(values: Column) -> Column:
    """Of an array without nulls; null when empty."""
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _sided(bars: DataFrame, step_ms: int, chunk_bars: int) -> DataFrame:
    """Each bar as it is (side 1) and upside down (side -1), with its pivots ``top`` and ``bottom`` at their own bars.

    Upside down, falling structure reads as rising, so every rule is written once.
    """
    x = chunked(bars, step_ms, chunk_bars).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    flip = lambda c: F.col("side") * F.col(c)
    x = x.withColumns({"up": F.when(F.col("side") > 0, F.col("high")).otherwise(-F.col("low")), "dn": F.when(F.col("side") > 0, F.col("low")).otherwise(-F.col("high")), "c": flip("close"), "e": flip("ema20")})
    x = x.withColumn("_gap", F.coalesce(F.col("i") - F.lag("i").over(Window.partitionBy("symbol", "side", "chunk").orderBy("i")) != 1, F.lit(True)).cast("int"))
    x = x.withColumn("run", F.sum("_gap").over(Window.partitionBy("symbol", "side", "chunk").orderBy("i"))).drop("_gap")
    w = Window.partitionBy("symbol", "side", "chunk", "run").orderBy("i")
    before, after = w.rowsBetween(-LEFT, -1), w.rowsBetween(1, RIGHT)
    past = F.lag("c").over(w)
    x = x.withColumn("tr", F.coalesce(F.greatest(F.col("up") - F.col("dn"), F.abs(F.col("up") - past), F.abs(F.col("dn") - past)), F.col("up") - F.col("dn")))
    whole = (F.count(F.lit(1)).over(before) == LEFT) & (F.count(F.lit(1)).over(after) == RIGHT)
    is_top = whole & (F.col("up") > F.max("up").over(before)) & (F.col("up") >= F.max("up").over(after))
    is_bottom = whole & (F.col("dn") < F.min("dn").over(before)) & (F.col("dn") <= F.min("dn").over(after))
    height = F.greatest(F.lit(0.0), F.col("up") - F.greatest(F.min("dn").over(before), F.min("dn").over(after)))
    depth = F.greatest(F.lit(0.0), F.least(F.max("up").over(before), F.max("up").over(after)) - F.col("dn"))
    x = x.withColumns({"is_top": is_top, "is_bottom": is_bottom, "top_prominence": height, "bottom_prominence": depth, "known_atr": F.lead("atr", RIGHT).over(w)})
    fits = lambda p: (F.col("known_atr") > 0) & (F.col(p) / F.col("known_atr") >= MIN_PROMINENCE_ATR)
    point = lambda price: F.struct("i", F.col(price).alias("price"), "known_atr", "tr", "quote_volume")
    return x.withColumns({"top": F.when(F.col("is_top") & fits("top_prominence"), point("up")), "bottom": F.when(F.col("is_bottom") & fits("bottom_prominence"), point("dn"))})


def qualified_pivots(bars: DataFrame, step_ms: int, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """symbol, open_time_ms, kind, price, prominence_atr and known_ms of the pivots prominent enough when they become known.

    ``bars``: symbol, open_time_ms, high, low, close, quote_volume, atr and ema20, closed, once per symbol and time; a gap starts anew.
    """
    x = _sided(bars, step_ms, chunk_bars).where("top is not null")
    # a pivot belongs to the chunk of the bar at which it is known, which has all bars around it
    x = x.where(F.floor((F.col("i") + RIGHT) / chunk_bars) == F.col("chunk"))
    kind = F.when(F.col("side") > 0, "high").otherwise("low")
    return x.select("symbol", "open_time_ms", kind.alias("kind"), (F.col("side") * F.col("top.price")).alias("price"), (F.col("top_prominence") / F.col("known_atr")).alias("prominence_atr"), (F.col("open_time_ms") + RIGHT * step_ms).alias("known_ms"))


def structure(bars: DataFrame, step_ms: int, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Swing state, trend lines and pullback of each bar, from what was known one bar before.

    ``bars`` as for ``qualified_pivots``.  Returns symbol, open_time_ms, close,
    reference_atr, high_count and low_count, and, where two of each are known
    and ATR and EMA20 exist, state (bullish, bearish or mixed), the changes of
    the swings in ATR, support and resistance (null where not positive) with
    their slopes in ATR, support_broken and resistance_broken, and for a
    bullish or bearish state the pullback: pullback_direction, pullback_status
    (invalid, ready, developing or none), impulse_start, impulse_end,
    impulse_size_atr, pullback_depth, pullback_bars, confluence_atr,
    range_ratio, quote_ratio, recovered and intact.
    """
    x = _sided(bars, step_ms, chunk_bars)
    w = Window.partitionBy("symbol", "side", "chunk", "run").orderBy("i")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"prior_top": F.last("top", True).over(earlier), "prior_bottom": F.last("bottom", True).over(earlier)})
    leg = Window.partitionBy("symbol", "side", "chunk", "run", F.col("prior_bottom.i")).orderBy("i").rowsBetween(-TTL_BARS, 0)
    x = x.withColumn("_leg", F.collect_list(F.struct("tr", "quote_volume")).over(leg))
    # the lists of a leg are needed at tops only
    legs = F.when(F.col("top").isNotNull() & F.col("prior_bottom").isNotNull(), F.col("_leg"))
    with_start = lambda c: F.concat(F.array(F.col(f"prior_bottom.{c}")), F.col(f"_leg.{c}"))
    low = F.struct(F.col("dn").alias("price"), "i", F.lag("atr").over(w).alias("atr"), F.lag("e").over(w).alias("e"), "tr", "quote_volume")
    x = x.withColumn("_leg", legs).withColumns({"leg_range": _median(with_start("tr")), "leg_quote": _median(with_start("quote_volume")), "low": low})
    near = F.array(*(F.lead("low", k).over(w) for k in range(1, RIGHT + 1)))
    found = F.struct("top.i", "top.price", "top.known_atr", F.struct("prior_top.i", "prior_top.price").alias("prior"), F.struct("prior_bottom.i", "prior_bottom.price").alias("start"), "leg_range", "leg_quote", near.alias("near"))
    x = x.withColumn("_t", F.when(F.col("top").isNotNull(), found)).withColumn("_b", F.when(F.col("bottom").isNotNull(), F.struct("bottom.i", "bottom.price", F.struct("prior_bottom.i", "prior_bottom.price").alias("prior"))))
    # from their own bar to the one at which they are known
    x = x.drop("_leg", "top", "bottom", "prior_top", "prior_bottom").withColumns({"_t": F.lag("_t", RIGHT).over(w), "_b": F.lag("_b", RIGHT).over(w)})
    known = w.rowsBetween(-(TTL_BARS - RIGHT), -1)
    x = x.withColumns(
        {
            "t": F.last("_t", True).over(known), "b": F.last("_b", True).over(known), "n_t": F.count("_t").over(known), "n_b": F.count("_b").over(known),
            "ref": F.lag("atr").over(w), "ref_e": F.lag("e").over(w), "past_up": F.lag("up").over(w), "place": F.row_number().over(w),
        }
    )
    since = Window.partitionBy("symbol", "side", "chunk", "run", F.col("t.i")).orderBy("i")
    x = x.withColumns({"_low": F.min("low").over(since), "_lows": F.collect_list(F.struct("low.tr", "low.quote_volume")).over(since.rowsBetween(-TTL_BARS, 0))})
    x = x.where("own and place > 1")
    usable = (F.col("ref") > 0) & F.col("ref_e").isNotNull()
    two = usable & (F.col("n_t") >= 2) & (F.col("n_b") >= 2)
    change_t, change_b = F.col("t.price") - F.col("t.prior.price"), F.col("b.price") - F.col("b.prior.price")
    equal = EQUALITY_ATR * F.col("ref")
    rising, falling = two & (change_t > equal) & (change_b > equal), two & (change_t < -equal) & (change_b < -equal)
    slope = lambda p: (F.col(f"{p}.price") - F.col(f"{p}.prior.price")) / (F.col(f"{p}.i") - F.col(f"{p}.prior.i"))
    line = lambda p: F.col(f"{p}.price") + slope(p) * (F.col("i") - F.col(f"{p}.i"))
    state = F.when(rising, "bullish").when(falling, "bearish").when(two, "mixed")
    support, resistance = F.when(line("b") > 0, line("b")), F.when(line("t") > 0, line("t"))
    swings = x.where("side = 1").select(
        "symbol", "open_time_ms", "close", F.when(usable, F.col("ref")).alias("reference_atr"), F.when(usable, F.col("n_t")).alias("high_count"), F.when(usable, F.col("n_b")).alias("low_count"), state.alias("state"),
        F.when(two, change_t / F.col("ref")).alias("high_change_atr"), F.when(two, change_b / F.col("ref")).alias("low_change_atr"),
        F.when(two, support).alias("support"), F.when(two, resistance).alias("resistance"),
        F.when(two, slope("b") / F.col("ref")).alias("support_slope_atr"), F.when(two, slope("t") / F.col("ref")).alias("resistance_slope_atr"),
        F.when(two, F.coalesce(F.col("close") < support, F.lit(False))).alias("support_broken"), F.when(two, F.coalesce(F.col("close") > resistance, F.lit(False))).alias("resistance_broken"),
    )
    # a pullback is one from a rising structure, upside down or not
    start, side = F.col("t.start"), F.col("side")
    p = x.where(rising & (start["i"] >= F.col("i") - TTL_BARS) & (F.col("t.price") > start["price"]))
    p = p.withColumn("ext", F.array_min(F.concat(F.array("_low"), F.col("t.near"))))
    impulse = F.col("t.price") - start["price"]
    p = p.withColumns(
        {
            "impulse_size_atr": impulse / F.col("t.known_atr"),
            "pullback_depth": (F.col("t.price") - F.col("ext.price")) / impulse,
            "pullback_bars": F.col("i") - F.col("t.i"),
            "confluence_atr": F.when((F.col("ext.atr") > 0) & F.col("ext.e").isNotNull(), F.abs(F.col("ext.price") - F.col("ext.e")) / F.col("ext.atr")),
            "recovered": F.col("c") > F.col("past_up"),
            "intact": F.col("c") >= start["price"] - BREAK_BUFFER_ATR * F.col("ref"),
        }
    )
    rows = lambda c: F.concat(F.col(f"t.near.{c}"), F.col(f"_lows.{c}"))
    ratio = lambda c, base: F.when(F.col(base) > 0, _median(rows(c)) / F.col(base))
    strong = F.col("impulse_size_atr") >= MIN_IMPULSE_ATR
    soon = F.col("pullback_bars") <= MAX_PULLBACK_BARS
    ready = strong & F.col("pullback_depth").between(MIN_DEPTH, MAX_DEPTH) & soon & F.coalesce(F.col("confluence_atr") <= CONFLUENCE_ATR, F.lit(False)) & F.col("recovered") & F.col("intact")
    status = F.when(~F.col("intact") | (F.col("pullback_depth") > INVALID_DEPTH), "invalid").when(ready, "ready").when(strong & F.col("pullback_depth").between(0, INVALID_DEPTH) & soon, "developing").otherwise("none")
    pulls = p.select(
        "symbol", "open_time_ms", F.when(side > 0, "long").otherwise("short").alias("pullback_direction"), status.alias("pullback_status"), (side * start["price"]).alias("impulse_start"), (side * F.col("t.price")).alias("impulse_end"),
        "impulse_size_atr", "pullback_depth", "pullback_bars", "confluence_atr", ratio("tr", "t.leg_range").alias("range_ratio"), ratio("quote_volume", "t.leg_quote").alias("quote_ratio"), "recovered", "intact",
    )
    return swings.join(pulls, ["symbol", "open_time_ms"], "left")


def pullback_rules(bars: DataFrame, found: DataFrame, setup_score: int = 70) -> DataFrame:
    """symbol, open_time_ms, family, direction, score, triggered, eligible and invalidation of both pullback families on each bar.

    ``bars``: symbol, open_time_ms, close, atr, ema20, ema50 and slope (of EMA20
    in ATR); ``found`` from ``structure``.  Points: trend 20, structure and
    impulse 20, depth 20, duration 15, confluence 10, recovery 15; a rule that
    is not ready stays under ``setup_score`` and one without the structure of
    its direction has none.  The families are informational: never eligible.
    """
    x = bars.join(found.drop("close"), ["symbol", "open_time_ms"])
    x = x.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    d = F.col("direction")
    no = lambda c: F.coalesce(c, F.lit(False))
    trend = no((d * (F.col("close") - F.col("ema50")) > 0) & (d * (F.col("ema20") - F.col("ema50")) > 0) & (d * F.col("slope") > 0))
    mine = no(F.col("pullback_direction") == F.when(d > 0, "long").otherwise("short"))
    structural = mine & no(F.col("impulse_size_atr") >= MIN_IMPULSE_ATR)
    depth = no(F.col("pullback_depth").between(MIN_DEPTH, MAX_DEPTH))
    duration = no(F.col("intact") & (F.col("pullback_bars") <= MAX_PULLBACK_BARS))
    confluence = no(F.col("confluence_atr") <= CONFLUENCE_ATR)
    recovered = no(F.col("recovered"))
    points = sum((F.when(c, n).otherwise(0) for c, n in ((trend, 20), (structural, 20), (depth, 20), (duration, 15), (confluence, 10), (recovered, 15))), F.lit(0))
    ready = no(F.col("pullback_status") == "ready") & trend & structural & depth & duration & confluence & recovered
    score = F.when(~structural, 0).when(~ready, F.least(points, F.lit(setup_score - 1))).otherwise(points)
    family = F.when(d > 0, "pullback_long").otherwise("pullback_short")
    return x.select("symbol", "open_time_ms", family.alias("family"), "direction", score.alias("score"), ready.alias("triggered"), F.lit(False).alias("eligible"), (F.col("impulse_start") - d * BREAK_BUFFER_ATR * F.col("atr")).alias("invalidation"))
