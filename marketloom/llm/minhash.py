"""Near-duplicate documents by MinHash with tensored banding (operator 2).

Two collections of ``collections`` small groups of ``rows`` minhashes each are
computed per document.  Every pair (group of the first, group of the second)
is a table, so ``collections ** 2`` tables of ``2 * rows`` minhashes each cost
only ``2 * collections * rows`` minhashes: about the square root of what the
same tables would cost apart.  With ten collections of two, a pair at the
threshold of 0.8 is missed with a chance of 1 in 13,000, and pairs above it
far less often.

Documents with equal shingle sets are one class first, so copies cost nothing
further.  A class takes part in tables only through groups that another class
has too.  In each table all classes are held against the table's smallest and
largest class.  Classes of tables that still hold several components are then
paired across components through their rarest shingles, which similar sets must
share; so no link of a table is lost and pairs within a group are never all
made.  Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, flatten, mix, prefix_hash, slices, span_hash, words
from .tables import components, join_bytes, packed, parts, row_key, salted_join, small_or_shuffled, unpack, with_row_key, written

SHINGLE_WORDS = 5
PERCENT = 80
COLLECTIONS = 10
ROWS = 2
PARITY_BITS = 1024
_U = np.uint64
_WORD_STEP = _U(0xD6E8FEB86659FD93)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A
    text with fewer than ``size`` words has its whole sequence as its one
    shingle; a text without words has none.
    """
    x = LOWER[buf]
    start, end, row = words(x, off)
    n_rows = len(off) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    word = span_hash(x, prefix_hash(x), start, end)
    n = len(word)
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    wide = np.zeros(n, np.uint64)
    for i in range(min(size, n)):
        wide[: n - i] = wide[: n - i] * _WORD_STEP + word[i:]
    ok = np.zeros(n, bool)
    ok[: n - size + 1] = row[: n - size + 1] == row[size - 1 :] if n >= size else False
    values, rows = mix(wide[ok]), row[ok]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for i in range(size - 1):
            has = count[few] > i
            at = first[few[has]] + i
            whole[has] = whole[has] * _WORD_STEP + word[at]
        values = np.concatenate([values, mix(whole ^ count[few].astype(np.uint64))])
        rows = np.concatenate([rows, few])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
    values, rows = values[fresh], rows[fresh]
    bounds = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=bounds[1:])
    return values, bounds


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and 64-bit keys of the sets (0 for an empty one)."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    keys = np.zeros(len(sizes), np.uint64)
    if len(full):
        total = np.add.reduceat(mix(values), bounds[:-1][full])
        keys[full] = mix(total ^ mix(sizes[full].astype(np.uint64))) | _U(1)
    return sizes, keys.view(np.int64)


def group_keys(values: np.ndarray, bounds: np.ndarray, collections: int, rows: int) -> np.ndarray:
    """Two collections of minhash groups of each non-empty set; the last bit tells the collection."""
    rng = np.random.default_rng(977)
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(full), 2 * collections), np.uint64)
    if not len(full):
        return out.view(np.int64)
    starts = bounds[:-1][full]
    for j in range(2 * collections):
        key = np.full(len(full), j + 1, np.uint64)
        for _ in range(rows):
            factor = _U(int(rng.integers(1, 1 << 63)) * 2 + 1 & (1 << 64) - 1)
            key = mix(key + np.minimum.reduceat(values * factor, starts))
        out[:, j] = key & ~_U(1) | _U(j >= collections)
    return out.view(np.int64)


def _classify(docs: DataFrame, size: int, collections: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in parts(batches, 1024):
            buf, off = flatten(batch.column("text"))
            sizes, keys, groups = [], [], []
            for a, b in slices(off):
                values, bounds = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], size)
                n, k = set_keys(values, bounds)
                sizes.append(n)
                keys.append(k)
                full = np.zeros((b - a, 2 * collections), np.int64)
                full[n > 0] = group_keys(values, bounds, collections, rows)
                groups.append(full)
            if not sizes:
                continue
            n, k, g = np.concatenate(sizes), np.concatenate(keys), np.concatenate(groups)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * collections, pa.int32()), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(n, pa.int64()), pa.array(k, mask=n == 0), lists], ["doc_id", "row_key", "n_shingles", "node", "groups"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {kind}, row_key binary, n_shingles long, node long, groups array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""

    def run(batches):
        for batch in parts(batches, 1024):
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = part.num_rows
                values, bounds = shingle_sets(*join_bytes(unpack(part.column("text_a")) + unpack(part.column("text_b"))), size)
                for i in range(rows):
                    x, y = values[bounds[i] : bounds[i + 1]], values[bounds[rows + i] : bounds[rows + i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[lo + i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    # the hub of a large group, which has many pairs, is split over tasks
    pairs = joined = written(pairs)
    for x, other in ("ab", "ba"):
        side = texts.select(F.col("node").alias(x), F.col("packed").alias(f"text_{x}"), F.col("n").alias(f"n_{x}")).join(pairs.groupBy(x).agg(F.count("*").alias("links")), x)
        joined = salted_join(joined, side, [x], "links", other)
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return joined.where(near).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def parity(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set the parities of how many of its hashes begin with each of ``PARITY_BITS`` values, as longs."""
    rows = len(bounds) - 1
    top = (values >> _U(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(rows), np.diff(bounds)) * PARITY_BITS + top, minlength=rows * PARITY_BITS) & 1
    bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (PARITY_BITS // 64), pa.int32()), pa.array(bits))


def _by_rare_shingles(texts: DataFrame, unsure: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of ``unsure`` classes of different components that share one of their rarest shingles.

    Similar sets of n shingles share at least percent of n, so they share one
    of the rarest (100 - percent) % of n, plus one, in any common order.  Those
    with more shingles that nobody else has than that are similar to none.
    Each set also has a parity bit for each of ``PARITY_BITS`` hash values: two
    sets differ in at least as many shingles as parity bits, which rules out
    pairs inside the join.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                values, bounds = shingle_sets(*join_bytes(unpack(part.column("packed"))), size)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64))), parity(values, bounds)], ["node", "root", "set", "parity"])

    sets = texts.select("node", "packed").join(unsure, "node").mapInArrow(run, "node long, root long, set array<long>, parity array<long>")
    sets = written(sets.withColumn("n", F.size("set")))
    single = sets.select("node", F.explode("set").alias("shingle"))
    common = single.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    shared = single.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - (F.col("n") - F.size("shared"))
    rare = shared.join(sets.select("node", "root", "n", "parity"), "node").withColumn("first", first.cast("int")).where("first > 0")
    rare = written(rare.select("node", "root", "n", "parity", F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("x")).select("node", "root", "n", "parity", "x.shingle"))
    a, b = (rare.select("shingle", F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    # of n_a + n_b, similar sets differ in (100 - percent) / (100 + percent) at most
    alike = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    near = alike & (F.col("root_a") < F.col("root_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return a.join(b, "shingle").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by 100 * |intersection| >= percent * |union| of their word shingles.

    Returns one row per input row: doc_id, row_key (see ``with_row_key``),
    n_shingles, component_id (smallest doc_id reachable over links), kept
    (doc_id = component_id).  Texts without words, and null texts, have no
    shingles and are their own component.  Rows with a null doc_id take no part:
    component_id is null and kept is true.  Equal rows are linked and share
    kept; an empty table gives an empty result; other columns are ignored.
    """
    keyed = with_row_key(docs.select("doc_id", "text"))
    base = written(_classify(keyed, size, collections, rows))
    live = base.where("node is not null and doc_id is not null")
    classes = written(live.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("groups").alias("groups")))
    half = classes.select("node", F.explode("groups").alias("key"))
    shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    sides = half.join(shared, "key").groupBy("node").agg(
        F.collect_list(F.when(F.col("key").bitwiseAND(1) == 0, F.col("key"))).alias("left"), F.collect_list(F.when(F.col("key").bitwiseAND(1) == 1, F.col("key"))).alias("right")
    )
    tables = written(sides.select("node", "right", F.explode("left").alias("x")).select("node", "x", F.explode("right").alias("y")).select("node", F.xxhash64("x", "y").alias("table")))
    ends = tables.groupBy("table").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = written(tables.join(ends, "table"))
    ids = buckets.select("node").distinct().join(classes.select("node", "rep", "n"), "node")
    texts = packed(keyed.where("doc_id is not null"), ["doc_id", "text"]).withColumnRenamed("doc_id", "rep").join(ids, "rep")
    texts = written(_own(texts, size).dropDuplicates(["node"]))
    pairs = buckets.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    links = written(_confirm(pairs, texts, size, percent))
    roots = components(links)
    # tables whose classes are in several components: pairs across these that can be similar at all
    parts = buckets.select("table", "node").join(roots, "node", "left").select("table", "node", F.coalesce("root", "node").alias("root"))
    open_tables = parts.groupBy("table").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("table")
    unsure = written(parts.join(open_tables, "table", "left_semi").select("node", "root").distinct())
    across = _by_rare_shingles(texts, unsure, size, percent).join(pairs, ["a", "b"], "left_anti").join(pairs.toDF("b", "a"), ["a", "b"], "left_anti")
    roots = components(roots.toDF("a", "b").union(_confirm(across, texts, size, percent)))
    member = classes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = member.join(lowest, "root").select("node", "component_id")
    out = base.drop("groups").join(found, "node", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest doc_id.

    Rows equal in doc_id and text become one, unless they have no words.
    """
    flags = written(near_duplicates(docs.select("doc_id", "text"), size, percent))
    dropped = written(flags.where("not kept").select("row_key").distinct())
    whole = docs.select(row_key(), F.struct(*docs.columns).alias("whole"))
    kept = whole.join(small_or_shuffled(dropped), "row_key", "left_anti")
    again = flags.where("n_shingles > 0 and doc_id is not null").groupBy("row_key").count().where("count > 1").select("row_key")
    if again.limit(1).count():
        kept = kept.join(again, "row_key", "left_anti").unionByName(kept.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return kept.select("whole.*")


def _own(texts: DataFrame, size: int) -> DataFrame:
    """Of the texts joined by doc_id, those that are their class's (a doc_id may have several texts)."""

    def run(batches):
        for batch in batches:
            keep = []
            node = batch.column("node").to_numpy()
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                _, keys = set_keys(*shingle_sets(*join_bytes(unpack(part.column("packed"))), size))
                keep.append(keys == node[lo : lo + 128])
            if keep:
                yield batch.select(["node", "packed", "n"]).filter(pa.array(np.concatenate(keep)))

    return texts.select("node", "packed", "n").mapInArrow(run, "node long, packed binary, n long")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: 4-word shingles, similarity 0.8."""
    return near_duplicates(docs, size=4).drop("row_key")
