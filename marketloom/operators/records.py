"""Strict records, alignment of variants, sign panels, and order statistics of sliding windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import placed


def strict_rates(rows: DataFrame, expected: str, body: str) -> DataFrame:
    """(columns, time_ms, rate, valid): JSON of symbol, fundingTime and fundingRate, all three right or the row is invalid."""
    j = F.from_json(body, "symbol string, fundingTime string, fundingRate string")
    x = rows.withColumn("_j", j)
    time, rate = F.expr("try_cast(_j.fundingTime as bigint)"), F.expr("try_cast(_j.fundingRate as double)")
    x = x.withColumns({"time_ms": time, "rate": rate})
    valid = (F.col("_j.symbol") == F.col(expected)) & (F.col("time_ms") >= 0) & F.col("rate").isNotNull() & ~F.isnan("rate") & (F.abs("rate") != F.lit(float("inf")))
    return x.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_j")


def depth_rows(rows: DataFrame, body: str) -> DataFrame:
    """(columns, first_id, final_id, previous_id, bids, asks, valid): a depth update with its levels as (price, qty).

    Valid: the three ids are there and in order, and every level has two numbers.
    """
    x = rows.withColumn("_j", F.from_json(body, "b array<array<string>>, a array<array<string>>"))
    # U and u differ in case only, which names of struct fields do not tell apart
    number = lambda name: F.get_json_object(body, f"$.{name}").try_cast("long")
    level = lambda s: F.struct(s[0].try_cast("double").alias("price"), s[1].try_cast("double").alias("qty"))
    x = x.withColumns({"first_id": number("U"), "final_id": number("u"), "previous_id": number("pu"), "bids": F.transform("_j.b", level), "asks": F.transform("_j.a", level)})
    whole = lambda c: F.forall(c, lambda s: s["price"].isNotNull() & s["qty"].isNotNull())
    valid = (F.col("first_id") <= F.col("final_id")) & (F.col("previous_id") < F.col("final_id")) & whole("bids") & whole("asks")
    return x.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_j")


def frames(rows: DataFrame, payload: str, encoding: str, streams: str) -> DataFrame:
    """(columns, text, stream, known): the payload as text, base64 or not, its stream, and whether that was subscribed."""
    text = F.when(F.col(encoding) == "base64", F.unbase64(payload).cast("string")).otherwise(F.col(payload))
    x = rows.withColumn("text", text).withColumn("stream", F.get_json_object("text", "$.stream"))
    return x.withColumn("known", F.coalesce(F.array_contains(streams, F.col("stream")), F.lit(False)))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, state): left_only, right_only, same or changed by content, nulls being equal."""
    l = left.select(*keys, F.struct(*content).alias("_l"))
    r = right.select(*keys, F.struct(*content).alias("_r"))
    x = l.join(r, keys, "full")
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_l").eqNullSafe(F.col("_r")), "same").otherwise("changed")
    return x.select(*keys, state.alias("state"))


def relation(a: Column, b: Column) -> Column:
    """How two signs stand to each other."""
    return F.when((a == 0) | (b == 0), "neutral").when(a == b, "aligned").otherwise("opposed")


def topology(signs: list[Column]) -> Column:
    """Counts of positive, negative and zero signs as text, such as ``2+1-0=``."""
    count = lambda v: sum(((s == v).cast("int") for s in signs), F.lit(0)).cast("string")
    return F.concat(count(1), F.lit("+"), count(-1), F.lit("-"), count(0), F.lit("="))


def pair_rates(rows: DataFrame, by: list[str], leaves: list[str]) -> DataFrame:
    """(by, pair, relation, n) of every pair of sign columns, in one pass without a self-join."""
    pairs = [F.struct(F.lit(f"{a}/{b}").alias("pair"), relation(F.col(a), F.col(b)).alias("relation")) for i, a in enumerate(leaves) for b in leaves[i + 1 :]]
    return rows.select(*by, F.inline(F.array(*pairs))).groupBy(*by, "pair", "relation").agg(F.count("*").alias("n"))


def selections(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Each row once for every selection that it belongs to, named in ``selection``."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(name)) for name, p in predicates.items())))
    return rows.withColumn("selection", F.explode(names))


def late_conflicts(rows: DataFrame, keys: list[str], time: str, receipt: str, cutoff: str, value: str) -> DataFrame:
    """(keys, frozen, n_late, n_conflicts): the answer admitted by the cut-off, and later rows that differ from it."""
    admitted = (F.col(time) <= F.col(cutoff)) & (F.col(receipt) <= F.col(cutoff))
    frozen = F.max_by(value, F.when(admitted, F.struct(time, receipt, value))).over(Window.partitionBy(*keys))
    x = rows.withColumns({"_admitted": admitted, "frozen": frozen})
    return x.groupBy(*keys, "frozen").agg(F.count_if(~F.col("_admitted")).alias("n_late"), F.count_if(~F.col("_admitted") & (F.col(value) != F.col("frozen"))).alias("n_conflicts"))


def _sliding(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, mean absolute deviation's median and weak ECDF of each value against its ``n`` prior ones."""
    median, mad, ecdf = (np.full(len(values), np.nan) for _ in range(3))
    if len(values) <= n:
        return median, mad, ecdf
    window = np.sort(values[:n])
    low, high = (n - 1) // 2, n // 2
    for i in range(n, len(values)):
        new, old = values[i], values[i - n]
        middle = (window[low] + window[high]) / 2
        apart = np.partition(np.abs(window - middle), (low, high))
        median[i], mad[i] = middle, (apart[low] + apart[high]) / 2
        ecdf[i] = np.searchsorted(window, new, "right") / n
        # the oldest value leaves the sorted window and the new one enters
        j, k = np.searchsorted(window, old), np.searchsorted(window, new)
        if j < k:
            window[j : k - 1] = window[j + 1 : k]
            window[k - 1] = new
        else:
            window[k + 1 : j + 1] = window[k:j]
            window[k] = new
    return median, mad, ecdf


def sorted_window(rows: DataFrame, keys: list[str], order: list[str], column: str, n: int, chunk_rows: int = 50_000, bucket: int | None = None) -> DataFrame:
    """Adds prior_median, prior_mad and prior_ecdf of ``column`` over the ``n`` rows strictly before each row.

    Null until there are ``n``.  A long series is cut in chunks that begin ``n``
    rows early, so one key is many groups, and each keeps one sorted window
    instead of a list of ``n`` values for every row.  Rows without a value are
    left out; ``n`` is at most ``chunk_rows``.  With ``bucket``, a step of the
    first order column, no task sorts a whole key to number its rows.
    """
    if not 0 < n <= chunk_rows:
        raise ValueError("n must be between 1 and chunk_rows")
    names = list(rows.columns)
    if clash := {"_rn", "_own", "_chunk", "_bucket", "_at"} & set(names):
        raise ValueError(f"columns in use here: {sorted(clash)}")
    numbered = placed(rows.where(F.col(column).isNotNull()), keys, order, "_rn", bucket)
    own = F.floor(F.col("_rn") / chunk_rows).cast("int")
    needed = F.when(F.col("_rn") % chunk_rows >= chunk_rows - n, F.array(own, own + 1)).otherwise(F.array(own))
    chunks = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(needed))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rn", kind="stable")
        median, mad, ecdf = _sliding(group[column].to_numpy(float), n)
        out = group[names].assign(prior_median=median, prior_mad=mad, prior_ecdf=ecdf)
        return out[(group["_own"] == group["_chunk"]).to_numpy()]

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    out = chunks.groupBy(*keys, "_chunk").applyInPandas(run, fields + ", prior_median double, prior_mad double, prior_ecdf double")
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("prior_median", "prior_mad", "prior_ecdf")})
