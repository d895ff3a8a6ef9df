"""Quality rules with thresholds that adapt to language and source (operator 10).

Text measures come from flat byte kernels.  Their ratios go into mergeable
quantile sketches: counts of logarithmic bins, one row per language, source,
ratio and bin.  Sketches add up exactly, so the result does not depend on the
order of tasks; those of a language, and of all, are sums of the same rows.
Fences far outside the middle half of a group replace fixed cut-offs and are
joined back to the documents.  Documents that fail the base rules do not shape
them.  How far out a fence stands follows from the sketches alone: from the
width of the middle half, and from the step by which one more count changes the
ratio in the group's shorter documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import SPACE, flatten, lines, mix, prefix_hash, slices, span_hash, words
from .tables import parts, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The documents that the sketch of a group's language weighs beside the group's own, and that of all beside a language's.
PRIOR = 25
#: Relative width of a sketch bin, and the smallest ratio told from zero.
BIN_WIDTH = 1.02
SMALLEST = 1e-4
#: How many middle-half widths beyond it, and steps from the median, a fence stands.
REACH = 6.0
#: Ratios by the counts of their smallest step; a three-word window that occurs again marks six words.
STEPS = {"word_length": 0, "symbols_per_word": 1, "dup_lines_per_word": 1, "repeated_share": 6}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def _repeats(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the entries whose value occurs again in their row, and of those but the first of each."""
    again, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
    if len(values):
        key = mix(values + (rows.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later[order[1:][same]] = True
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
    return again, later


def measures(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    rows = len(off) - 1
    start, end, row = words(buf, off)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    full = ~SPACE[buf]
    n_words = np.bincount(row, minlength=rows)
    chars = per_row(full & ((buf & 0xC0) != 0x80))
    symbols = per_row(_SYMBOL[buf])
    prefix = prefix_hash(buf)
    a, b, owner = lines(buf, off)
    held = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(full, out=held[1:])
    keep = held[b] > held[a]
    _, later = _repeats(span_hash(buf, prefix, a[keep], b[keep]), owner[keep])
    dup = np.bincount(owner[keep][later], minlength=rows)
    marked = np.zeros(len(start), bool)
    if len(start) >= 3:
        word = span_hash(buf, prefix, start, end)
        window = mix((word[:-2] * _U(3) + word[1:-1]) * _U(0xD6E8FEB86659FD93) + word[2:])
        at = np.flatnonzero(row[:-2] == row[2:])
        again, _ = _repeats(window[at], row[at])
        for i in range(3):
            marked[at[again] + i] = True
    return [n_words, chars, symbols, dup, np.bincount(row[marked], minlength=rows)]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five measures of each document."""

    def run(batches):
        for batch in parts(batches, 1024):
            buf, off = flatten(batch.column("text"))
            found = [measures(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off)]
            if found:
                out = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *out], ["doc_id", "lang", "source", *MEASURES])

    kinds = dict(docs.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source"))
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, head + "".join(f", {m} long" for m in MEASURES))


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeated_share": F.col("n_repeat_words") / n,
    }


def sketches(found: DataFrame) -> DataFrame:
    """lang, source, ratio, bin, c: the mergeable sketch of each group; null groups are groups of their own.

    ``per_word``, one by the number of words, is sketched beside the ratios.
    """
    width = float(np.log(BIN_WIDTH))
    ratios = _ratios() | {"per_word": 1 / F.col("n_words")}
    pairs = F.array(*(F.struct(F.lit(k).alias("ratio"), F.floor(F.log(v + SMALLEST) / width).cast("int").alias("bin")) for k, v in ratios.items()))
    return found.where("n_words > 0").select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count("*").alias("c"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Size, quartiles (q1, q2, q3) and last tenth (q9) of the merged sketches of ``by``, and the q9 of ``per_word`` (step)."""
    merged = sketch.groupBy(*by, "ratio", "bin").agg(F.sum("c").alias("c"))
    group = Window.partitionBy(*by, "ratio")
    ranked = merged.withColumn("upto", F.sum("c").over(group.orderBy("bin"))).withColumn("n", F.sum("c").over(group))
    width = float(np.log(BIN_WIDTH))
    value = F.exp((F.col("bin") + 0.5) * width) - SMALLEST
    pick = [F.min(F.when(F.col("upto") * 20 >= F.col("n") * q, value)).alias(name) for name, q in (("q1", 5), ("q2", 10), ("q3", 15), ("q9", 18))]
    found = ranked.groupBy(*by, "ratio").agg(F.max("n").alias("n"), *pick)
    return found.withColumn("step", F.max(F.when(F.col("ratio") == "per_word", F.col("q9"))).over(Window.partitionBy(*by)))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, and the bounds low_<ratio> and high_<ratio> of each group; null where all sketches are of one value.

    A group's quantiles are blended with those of its language, which count as
    ``prior`` documents, and a language's with those of all in the same way.
    """
    names = ("q1", "q2", "q3", "step")
    mine = F.struct("n", *names)
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("r"), mine.alias("by_lang"))
    every = _quantiles(sketch, []).select(F.col("ratio").alias("ra"), mine.alias("by_all"))
    q = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r"))).join(every, F.col("ratio") == F.col("ra"))

    def blend(x: str, wide: str) -> Column:
        n = F.col(f"{x}.n")
        return F.struct(*(((n * F.col(f"{x}.{k}") + prior * F.col(f"{wide}.{k}")) / (n + prior)).alias(k) for k in names))

    q = q.select("lang", "source", "ratio", mine.alias("own"), "by_all", blend("by_lang", "by_all").alias("w")).withColumn("b", blend("own", "w"))
    middle = lambda x: F.col(f"{x}.q3") - F.col(f"{x}.q1")
    # a ratio without a step could be narrowed to nothing by copies: its language's width counts too, or that of all
    wider = F.greatest(middle("b"), middle("w"))
    wider = F.when(wider > 0, wider).otherwise(middle("by_all"))
    least = F.create_map(*(F.lit(x) for k, v in STEPS.items() for x in (k, float(v))))[F.col("ratio")] * F.col("b.step")
    half = F.when(least > 0, middle("b")).otherwise(wider)
    reach = F.when((half > 0) | (least > 0), F.lit(REACH))
    q = q.withColumn("low", F.least(F.col("b.q1") - reach * half, F.col("b.q2") - reach * least)).withColumn("high", F.greatest(F.col("b.q3") + reach * half, F.col("b.q2") + reach * least))
    columns = [f(F.when(F.col("ratio") == k, F.col(side))).alias(f"{side}_{k}") for k in STEPS for side, f in (("low", F.min), ("high", F.max))]
    return q.groupBy("lang", "source").agg(*columns)


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Measures and verdict of each document.

    Returns doc_id, the five measures, base_failed and kept.  base_failed:
    fewer than ``min_words`` words, or over ``max_repeat_percent`` percent of
    them in repeated three-word windows.  kept: not base_failed and every ratio
    inside the fences of its language and source.  One row per input row; a
    null text has no words and fails; null languages and sources are groups;
    equal rows get equal verdicts; an empty table gives an empty result; other
    columns are ignored.
    """
    found = written(measured(docs))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    bounds = fences(sketches(found.where(~failed))).withColumnsRenamed({"lang": "lang_b", "source": "source_b"})
    joined = found.join(bounds, F.col("lang").eqNullSafe(F.col("lang_b")) & F.col("source").eqNullSafe(F.col("source_b")), "left")
    inside = F.lit(True)
    for name, value in _ratios().items():
        inside = inside & F.coalesce(value.between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    return joined.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, five measures, base_failed, kept."""
    return quality(docs)
