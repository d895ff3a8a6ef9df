"""Directional rules on feature rows: scores, triggers, fan-out and picks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written
from .joins import asof


@dataclass(frozen=True)
class Rule:
    """``points`` of conditions add up to the score, which is 0 unless ``needs`` holds.

    A rule without a trigger of its own triggers at a score of 60.  Only
    eligible rules can confirm, and informational ones never do.
    """

    name: str
    direction: int
    needs: Column
    points: dict[int | tuple[int, str], Column] = field(default_factory=dict)
    trigger: Column | None = None
    invalidation: Column | None = None
    eligible: Column | None = None
    informational: bool = False

    def score(self) -> Column:
        total = sum((F.when(c, p[0] if isinstance(p, tuple) else p).otherwise(0) for p, c in self.points.items()), F.lit(0))
        return F.when(self.needs, F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0).cast("int")


_rules: dict[str, Rule] = {}


def register_rule(rule: Rule) -> Rule:
    """Makes the rule part of ``evaluate``; a later one of the same name replaces it."""
    _rules[rule.name] = rule
    return rule


def standard_rules() -> list[Rule]:
    """Squeeze, breakout, breakdown, exhaustion and capitulation on recursive and window features."""
    c = F.col
    squeezed = c("width_percentile") <= 20
    reach = F.greatest(c("atr"), c("close") * 0.001)
    to_high, to_low = c("recent_high") - c("close"), c("close") - c("recent_low")
    calm = c("atr") / c("close") * 100 <= 2
    up = (c("close") > c("recent_high")) & (c("previous_close") <= c("recent_high"))
    down = (c("close") < c("recent_low")) & (c("previous_close") >= c("recent_low"))
    rising = (c("macd_histogram") > 0) & (c("macd_histogram") > c("macd1"))
    falling = (c("macd_histogram") < 0) & (c("macd_histogram") < c("macd1"))
    trend, counter = c("ema20") > c("ema50"), c("ema20") < c("ema50")
    strong = c("adx") >= 20
    return [
        Rule("squeeze_long", 1, squeezed & to_high.between(0, reach), {35: squeezed, 25: to_high.between(0, reach), 15: trend, 10: calm}, F.lit(False), c("recent_low") - c("atr") * 0.25),
        Rule("squeeze_short", -1, squeezed & to_low.between(0, reach), {35: squeezed, 25: to_low.between(0, reach), 15: counter, 10: calm}, F.lit(False), c("recent_high") + c("atr") * 0.25),
        Rule("breakout_long", 1, up, {30: up, 15: rising, (10, "adx"): strong, (10, "ema"): trend}, up & rising & strong & trend, F.least(c("recent_high"), c("close") - c("atr"))),
        Rule("breakdown_short", -1, down, {30: down, 15: falling, (10, "adx"): strong, (10, "ema"): counter}, down & falling & strong & counter, F.greatest(c("recent_low"), c("close") + c("atr"))),
        Rule("exhaustion_short", -1, F.greatest("rsi", "rsi1") >= 70, {25: F.greatest("rsi", "rsi1") >= 70, (15, "wick"): c("upper_wick") >= 0.45, (15, "macd"): (c("macd_histogram") < c("macd1")) & (c("macd1") < c("macd2")), 10: c("close") < c("ema9")}, F.lit(False), c("recent_high") + c("atr") * 0.5),
        Rule("capitulation_long", 1, F.least("rsi", "rsi1") <= 30, {25: F.least("rsi", "rsi1") <= 30, (15, "wick"): c("lower_wick") >= 0.45, (15, "macd"): (c("macd_histogram") > c("macd1")) & (c("macd1") > c("macd2")), 10: c("close") > c("ema9")}, F.lit(False), c("recent_low") - c("atr") * 0.5),
    ]


def evaluate(features: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per feature row and rule: place (of the rule), family, direction, score, triggered, invalidation, eligible, informational."""
    all_rules = [*(rules or standard_rules()), *_rules.values()]
    rows = [
        F.struct(F.lit(i).alias("place"), F.lit(r.name).alias("family"), F.lit(r.direction).alias("direction"), r.score().alias("score"), F.coalesce(r.trigger if r.trigger is not None else r.score() >= 60, F.lit(False)).alias("triggered"), (r.invalidation if r.invalidation is not None else F.lit(None).cast("double")).alias("invalidation"), (r.eligible if r.eligible is not None else F.lit(True)).alias("eligible"), F.lit(r.informational).alias("informational"))
        for i, r in enumerate(all_rules)
    ]
    return features.select("*", F.explode(F.array(*rows)).alias("rule")).select(*features.columns, "rule.*")


def strongest(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """The best rule of each direction.

    Rules with evidence (a score, and not informational) that are eligible and
    triggered come first, then eligible ones, then those with evidence, then the
    higher score; of equals the first in the order of the rules.
    """
    evidence = ~F.col("informational") & (F.col("score") > 0)
    order = F.struct(evidence & F.col("eligible") & F.col("triggered"), evidence & F.col("eligible"), evidence, "score", "triggered", -F.col("place"))
    best = F.max_by(F.struct("family", "score", "triggered"), order)
    return evaluated.groupBy(*keys, "direction").agg(best.alias("best")).select(*keys, "direction", "best.*")


def state_changes(evaluated: DataFrame, watch: int = 40, setup: int = 60, cooldown_ms: int = 1_800_000, bucket_ms: int = 86_400_000) -> DataFrame:
    """Decisions of each (symbol, family): rows at which its stage changes, but for those in a cooldown.

    A confirmed decision starts a cooldown, in which changes of stage give no
    decision.  A fall to IDLE from WATCH or SETUP is INVALIDATED, with the last
    invalidation before it; one from CONFIRMED is none.  Cooldowns are equal
    intervals of which each starts after the last one's end, so the confirmed
    rows that decide are those that ``non_overlapping`` takes.
    """
    key = ["symbol", "family"]
    w = Window.partitionBy(*key).orderBy("open_time_ms")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    can = F.col("triggered") & F.col("eligible") & ~F.col("informational")
    stage = F.when(can, "CONFIRMED").when(F.col("score") >= setup, "SETUP").when(F.col("score") >= watch, "WATCH").otherwise("IDLE")
    x = evaluated.withColumn("desired", stage).withColumn("before", F.coalesce(F.lag("desired").over(w), F.lit("IDLE")))
    x = x.withColumn("_run", F.coalesce(F.count_if(F.col("desired") == "IDLE").over(before), F.lit(0)))
    held = F.last("invalidation", ignorenulls=True).over(Window.partitionBy(*key, "_run").orderBy("open_time_ms").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("invalidation", F.when(F.col("desired") == "IDLE", F.coalesce(held, "invalidation")).otherwise(F.col("invalidation")))
    x = written(x.where("desired <> before").select(*key, "open_time_ms", "before", "desired", "invalidation"))
    confirmed = x.where("desired = 'CONFIRMED'").select(*key, F.col("open_time_ms").alias("entry_ms"), (F.col("open_time_ms") + cooldown_ms).alias("exit_ms"))
    taken = non_overlapping(confirmed, key, "entry_ms", "exit_ms", [], bucket_ms)
    x = asof(x, taken, key, "open_time_ms", "entry_ms", max_age=cooldown_ms - 1)
    decides = F.col("matched").isNull() & ((F.col("desired") != "IDLE") | F.col("before").isin("WATCH", "SETUP"))
    named = F.when(F.col("desired") == "IDLE", "INVALIDATED").otherwise(F.col("desired"))
    return x.where(decides).select(*key, "open_time_ms", "before", named.alias("stage"), "invalidation")


def _successors(nodes: DataFrame, bucket_ms: int) -> DataFrame:
    """(g, x, e, nx, ne): for each node the first other one by exit and entry that enters at its exit or later.

    An as-of pass over time buckets: a window inside each bucket of a stratum
    and one over the buckets' minima, so that no stratum is one task.
    """
    empty = F.col("x") == F.col("e")
    bucket = lambda t: F.floor(F.col(t) / bucket_ms)
    # latest first; at equal times an empty interval comes after the query of its own exit and before those of others
    enter = nodes.select("g", bucket("e").alias("b"), F.col("e").alias("t"), F.when(empty, 2).otherwise(0).alias("side"), F.struct("x", "e").alias("best"), F.lit(None).cast("struct<x:bigint,e:bigint>").alias("of"))
    leave = nodes.select("g", bucket("x").alias("b"), F.col("x").alias("t"), F.when(empty, 1).otherwise(3).alias("side"), F.lit(None).cast("struct<x:bigint,e:bigint>").alias("best"), F.struct("x", "e").alias("of"))
    inside = Window.partitionBy("g", "b").orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    near = enter.union(leave).withColumn("best", F.min("best").over(inside)).where("of is not null")
    minima = enter.select("g", "b", "best").union(leave.select("g", "b", "best")).groupBy("g", "b").agg(F.min("best").alias("best"))
    later = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    far = minima.select("g", "b", F.min("best").over(later).alias("far"))
    found = near.join(far, ["g", "b"], "left").withColumn("best", F.least("best", "far"))
    return found.select("g", F.col("of.x").alias("x"), F.col("of.e").alias("e"), F.col("best.x").alias("nx"), F.col("best.e").alias("ne"))


def non_overlapping(episodes: DataFrame, by: list[str], entry: str, exit_: str, ties: list[str] | None = None, bucket_ms: int = 86_400_000) -> DataFrame:
    """Episodes of each stratum taken in time order, earliest exit first, each after the last one's exit.

    Returns ``by``, ``ties``, entry and exit.  Without ``by`` all episodes are
    one stratum.  Of episodes with the same entry and exit the least by ``ties``
    is taken.  Rows without entry or exit, or that exit before they enter, are
    no intervals.  Each episode points to its successor; reachability from the
    first one doubles with each round, and tables between rounds are written,
    so neither a stratum nor its chain has to fit a task.
    """
    ties = ties or []
    rows = episodes.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(exit_).cast("long").alias("x"), F.col(entry).cast("long").alias("e"), F.struct(F.lit(0).alias("_"), *ties).alias("tie")).where("e <= x")
    rows = written(rows)
    nodes = rows.groupBy("g", "x", "e").agg(F.min("tie").alias("tie"))
    jump = written(_successors(nodes.select("g", "x", "e"), bucket_ms))
    reached = written(nodes.groupBy("g").agg(F.min(F.struct("x", "e")).alias("n")).select("g", "n.*"))
    while True:
        onward = reached.join(jump, ["g", "x", "e"]).where("nx is not null").select("g", F.col("nx").alias("x"), F.col("ne").alias("e"))
        onward = written(onward)
        if onward.isEmpty():
            break
        reached = written(reached.union(onward))
        there = jump.select("g", F.col("x").alias("nx"), F.col("e").alias("ne"), F.col("nx").alias("nx2"), F.col("ne").alias("ne2"))
        jump = written(jump.where("nx is not null").join(there, ["g", "nx", "ne"]).select("g", "x", "e", F.col("nx2").alias("nx"), F.col("ne2").alias("ne")))
    # empty intervals overlap with none, so all of a kind are taken
    picked = nodes.where("e < x").unionByName(rows.where("e = x")).join(reached, ["g", "x", "e"], "left_semi")
    return picked.select(*(F.col("g")[c].alias(c) for c in by), *(F.col("tie")[c].alias(c) for c in ties), F.col("e").alias(entry), F.col("x").alias(exit_))
