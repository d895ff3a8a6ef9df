"""Mixing sources to target weights by entropy balancing (operator 8).

Each source gets a share of a token budget by its weight, no more than twice
its own tokens.  Inside a source, documents get rates between 0 and 2: of all
rates that meet the source's token target, those nearest in entropy to one copy
each.  Their odds are tilted exponentially by size,
``rate / (2 - rate) = exp(tilt * size)``, and the tilts solve a convex dual,
one variable per source, by Newton steps over the whole corpus at once: each
step is an aggregation of a table of (source, size, documents).

Documents of one source and size are a cell and share a rate.  Rates become
whole copies cell by cell, from large documents to small ones, and what a cell's
rounding takes too much or too little goes to the next; so the small documents
settle the rest of their source.  Inside a cell the further copies go to the
documents of the smallest hashes.

Sums are of whole numbers, so the result does not depend on the order of tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import row_key, small_or_shuffled, with_row_key, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_COPIES = 2
#: Sums of rate * size are of whole multiples of 1 / SUM_SCALE.
SUM_SCALE = 1 << 16
NEWTON_STEPS = 200
#: A source's tilt is final when its rates' tokens are within this share of its target.
TOLERANCE = 1e-4
#: Documents of a cell are ranked in parts of about so many.
PART_ROWS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size``, the number of words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """(source, total) -> (source, total, target).

    Sources in code point order, null last, weigh ``weights`` in turn.  Targets
    are shares of the budget by weight and stop at MOST_COPIES times the total;
    what is over is shared again by weight.  The level that results is found in
    one sort: with sources by cap per weight, those below the level are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.array(*map(F.lit, weights))[place].cast("double")).withColumn("cap", F.col("total").cast("double") * MOST_COPIES)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = weighed.withColumns(
        {
            "budget": F.sum("total").over(every) * (budget_percent / 100.0),
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level if all sources before this one are full; the first one that it does not fill sets it
    x = x.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    x = x.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"])
    return x.select("source", "total", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    """Rate of a document, between 0 and 2."""
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt * size / mean))))


def tilts(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, mean, tilt, filled) by Newton steps on the dual, kept inside a shrinking bracket.

    ``filled`` marks sources whose target is all they can give.  A dual that
    is not solved after NEWTON_STEPS is an error.
    """
    docs = histogram.groupBy("source").agg(F.sum("docs").alias("n"))
    state = targets.join(docs, targets["source"].eqNullSafe(docs["source"])).select(
        targets["source"],
        "target",
        (F.greatest(F.col("total"), F.lit(1)) / F.col("n")).alias("mean"),
        (F.col("target") >= F.col("total") * MOST_COPIES).alias("filled"),
        F.lit(0.0).alias("tilt"),
        F.lit(-1e4).alias("low"),
        F.lit(1e4).alias("high"),
        F.lit(False).alias("met"),
    )
    state = written(state)
    steps = 0
    while state.where("not filled and not met").limit(1).count():
        steps += 1
        if steps > NEWTON_STEPS:
            raise RuntimeError(f"tilts of some sources not found in {NEWTON_STEPS} steps")
        s = state.withColumnRenamed("source", "of")
        rows = histogram.join(s, histogram["source"].eqNullSafe(F.col("of")))
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        tokens = F.sum((F.round(rate * SUM_SCALE).cast("long") * F.col("size") * F.col("docs")).cast("decimal(38,0)"))
        slope = F.sum(F.round(rate * (2 - rate) / 2 * F.col("size") / F.col("mean") * F.col("size") * F.col("docs")).cast("decimal(38,0)"))
        sums = rows.groupBy("of").agg((tokens / F.lit(SUM_SCALE)).cast("double").alias("tokens"), slope.cast("double").alias("slope"))
        x = state.join(sums, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        over = F.col("tokens") - F.col("target")
        x = x.withColumns({"met": F.abs(over) <= F.col("target") * TOLERANCE, "low": F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - F.try_divide(over, F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        inside = step.isNotNull() & (step > F.col("low")) & (step < F.col("high"))
        x = x.withColumn("tilt", F.when(F.col("filled") | F.col("met"), F.col("tilt")).when(inside, step).otherwise(middle))
        state = written(x.select(*state.columns))
    return state.select("source", "mean", "tilt", "filled")


def cell_copies(cells: DataFrame) -> DataFrame:
    """(source, size, docs, rate, target) -> (source, size, copies): whole copies of each cell, from 0 to 2 a document.

    One scan of a source's sizes, whose number grows with the square root of
    its words at most, however many documents it has.
    """

    def scan(table: pa.Table) -> pa.Table:
        order = np.argsort(-table["size"].to_numpy(), kind="stable")
        size, docs, rate = (table[c].to_numpy()[order] for c in ("size", "docs", "rate"))
        copies = np.zeros(len(size), np.int64)
        # what rates alone miss of the target is spread over the cells in proportion to their words
        words = rate * docs * size
        scale = table["target"][0].as_py() / words.sum() if words.sum() else 1.0
        carry = 0.0
        for i, (n, d, w) in enumerate(zip(size.tolist(), docs.tolist(), (words * scale).tolist(), strict=True)):
            if n == 0:
                copies[i] = d
                continue
            carry += w
            copies[i] = min(MOST_COPIES * d, max(0, int(np.floor(carry / n + 0.5))))
            carry -= copies[i] * n
        return pa.table({"source": table["source"].combine_chunks().take(pa.array(order)), "size": size, "copies": copies})

    return cells.groupBy("source").applyInArrow(scan, "source string, size long, copies long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """Copies of each document in the mix.

    Returns doc_id, row_key, size (words), source, source_size, target (both of
    the source), copies (0 to 2) and taken (copies * size), one row per input
    row.  A source's taken words differ from its target by half of its smallest
    document at most, unless its small documents are too few to settle what the
    large ones leave.  A null text has size 0; null sources are one source, the
    last; texts without words are taken once; a source without words has target
    0; equal rows may get different copies, but as a set always the same, and so
    does any order of rows; an empty table gives an empty result; other columns
    are ignored.
    """
    base = written(with_row_key(sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"))).select("doc_id", "row_key", "source", "size"))
    histogram = written(base.groupBy("source", "size").agg(F.count("*").alias("docs")))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("total"))
    targets = written(source_targets(totals, weights, budget_percent))
    tilt = tilts(histogram, targets).toDF("s1", "mean", "tilt", "filled")
    plan = targets.join(tilt, F.col("source").eqNullSafe(F.col("s1"))).select(F.col("source").alias("of"), F.col("total").alias("source_size"), "target", "mean", "tilt", "filled")
    cells = histogram.join(plan, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("filled") & (F.col("size") > 0), F.lit(float(MOST_COPIES))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean")))
    copies = cell_copies(cells.select("source", "size", "docs", "target", rate.alias("rate"))).select(F.col("source").alias("of"), F.col("size").alias("cell"), "copies")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("cell"))
    cells = written(cells.drop("of").join(copies, same).select("source", "size", "docs", "copies", "source_size", "target"))
    # a document's rank in its cell: those in parts of smaller hashes, then those before it in its own part
    largest = cells.agg(F.max("docs")).first()[0] or 1
    parts = 1 << max(0, (int(largest) // PART_ROWS).bit_length())
    key = F.xxhash64("row_key")
    x = base.withColumns({"key": key, "part": F.pmod(key, F.lit(parts)).cast("int")})
    by_part = x.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("begin", F.coalesce(F.sum("rows").over(along), F.lit(0))).withColumnsRenamed({"source": "of", "size": "cell"})
    parted = by_part.join(cells, same).select(F.col("of"), F.col("cell"), F.col("part").alias("p"), "begin", "docs", "copies", "source_size", "target")
    x = x.join(parted, same & (F.col("part") == F.col("p")))
    inside = Window.partitionBy("source", "size", "part").orderBy("key", "row_key")
    rank = F.col("begin") + F.row_number().over(inside) - 1
    base_copies = F.floor(F.col("copies") / F.col("docs"))
    own = (base_copies + (rank < F.col("copies") - base_copies * F.col("docs")).cast("int")).cast("int")
    return x.select("doc_id", "row_key", "size", "source", "source_size", "target", own.alias("copies")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with all its columns.

    Rows alike in doc_id and text stand for each other, so the copies of one of
    them may carry the other columns of another; null texts, nulls in other
    columns, ties and empty tables as in ``mix``; other columns may have any names.
    """
    plan = written(mix(docs, weights, budget_percent).select("row_key", "copies"))
    total = written(plan.groupBy("row_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    keyed = docs.select(row_key(), F.struct(*docs.columns).alias("whole"))
    if total.where("_rows > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["row_key"])
    out = keyed.join(small_or_shuffled(total.where("_copies > 0").select("row_key", "_copies")), "row_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("whole.*")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
