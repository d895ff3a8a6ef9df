"""Grouping of spelling variants by dense prefix-suffix tiling (operator 11).

Words one edit apart share a prefix and a suffix that together reach the longer
length minus one, so one of the two reaches half of it.  Words meet in buckets
of equal halves, once for each longer length they can belong to.  A bucket is
cut in blocks of words, and pairs of blocks are compared as padded matrices of
code points: the common prefix is taken on left-aligned rows, the common suffix
on right-aligned ones.  A bucket with many words becomes many pairs of blocks,
each a task of bounded size; only pairs that are near leave it, as sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import parts, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of letters is a maximal run of these.
LETTERS = "a-z\\u00C0-\\u00FF"
DELETED_EVERY = 199
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
BLOCK_WORDS = 512
#: Comparisons of code points that a task holds at once.
TILE_CELLS = 1 << 22


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, deleted_every: int | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, by their number in all texts.

    With ``deleted_every``, a run whose crc32 of ``doc_id:run`` it divides loses
    one code point (planted variants).  Counts are summed on the map side.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    # shorter runs cannot give a word of enough code points
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("word"))
    if deleted_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = F.pmod("h", F.char_length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        runs = runs.withColumn("h", h).withColumn("word", F.when(F.col("h") % deleted_every == 0, cut).otherwise(F.col("word")))
        runs = runs.where(F.char_length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and left- and right-aligned matrices of code points; the padding is no code point."""
    codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    size = np.array([len(c) for c in codes])
    left, right = (np.full((len(codes), size.max(initial=1)), 0xFFFFFFFF, np.uint32) for _ in range(2))
    for i, c in enumerate(codes):
        left[i, : len(c)] = c
        right[i, right.shape[1] - len(c) :] = c
    return size, left, right


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal leading cells of each row of ``a`` with each of ``b``, at most ``limit``."""
    same = a[:, None, :] == b[None, :, :]
    count = np.where(same.all(2), same.shape[2], same.argmin(2))
    return np.minimum(count, limit)


def near_in_tile(a: list[str], b: list[str], longer: int, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs a[i] < b[j] or a[i] > b[j] that are one edit apart.

    Only pairs whose longer length is ``longer`` count, and of these the ones
    whose common prefix reaches half of it (``prefix``) or does not (suffix
    buckets), so that a pair is found in one bucket only.
    """
    size_a, left_a, right_a = _padded(a)
    size_b, left_b, right_b = _padded(b)
    width = max(left_a.shape[1], left_b.shape[1])

    def grown(x: np.ndarray, front: bool) -> np.ndarray:
        more = width - x.shape[1]
        return np.pad(x, ((0, 0), (more, 0) if front else (0, more)), constant_values=0xFFFFFFFF)

    left_a, left_b, right_a, right_b = grown(left_a, False), grown(left_b, False), grown(right_a, True)[:, ::-1], grown(right_b, True)[:, ::-1]
    wide = max(1, min(len(b), TILE_CELLS // width))
    high = max(1, TILE_CELLS // (width * wide))
    found = []
    for i in range(0, len(a), high):
        for j in range(0, len(b), wide):
            la, lb = size_a[i : i + high, None], size_b[None, j : j + wide]
            least, most = np.minimum(la, lb), np.maximum(la, lb)
            p = _common(left_a[i : i + high], left_b[j : j + wide], least)
            s = _common(right_a[i : i + high], right_b[j : j + wide], least)
            same = (la == lb) & (p == la)
            near = (most == longer) & (p + s >= most - 1) & ((p >= longer // 2) == prefix) & ~same
            x, y = np.nonzero(near)
            found.append((x + i, y + j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near and best (least struct of -n and word) of the words (word, n) with a near word.

    Words are distinct and not null.  Two words are near if they differ by
    exactly one inserted, deleted or replaced code point.
    """
    size = F.char_length("word")
    kinds = []
    for more in (0, 1):
        longer = size + more
        half = F.floor(longer / 2).cast("int")
        kinds += [F.struct(F.lit(p).alias("prefix"), longer.alias("longer"), (F.left("word", half) if p else F.right("word", half)).alias("half")) for p in (True, False)]
    key = ["prefix", "longer", "half"]
    placed = words.select("word", "n", F.inline(F.array(*kinds)))
    counts = placed.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key, F.ceil(F.col("c") / block_words).cast("int").alias("blocks"))
    member = placed.join(written(counts), key).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # a block is one row, and goes to each pair of blocks that it is in
    blocks = member.groupBy(*key, "blocks", "block").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    tile: Column = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high"))))
    tiles = blocks.withColumn("tile", tile).groupBy(*key, "tile").agg(F.collect_list(F.struct((F.col("block") == F.col("tile.high")).alias("last"), "held")).alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            for row in batch.to_pylist():
                sides = sorted(row["sides"], key=lambda s: s["last"])
                a, b = sides[0]["held"], sides[-1]["held"]
                i, j = near_in_tile([x["word"] for x in a], [x["word"] for x in b], row["longer"], row["prefix"])
                if not len(i):
                    continue
                best: dict[str, list] = {}
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    # inside one block each pair stands twice already
                    for u, v in ((a[x], b[y]),) if len(sides) == 1 else ((a[x], b[y]), (b[y], a[x])):
                        have = best.setdefault(u["word"], [0, (-v["n"], v["word"])])
                        have[0] += 1
                        have[1] = min(have[1], (-v["n"], v["word"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best)), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1][0] for v in best.values()], pa.int64()), pa.array([v[1][1] for v in best.values()])],
                    ["word", "n_near", "less", "other"],
                )

    # a block whose partner got no words is alone in their tile
    tiles = tiles.where((F.col("tile.low") == F.col("tile.high")) | (F.size("sides") == 2))
    found = tiles.select("prefix", "longer", "sides").mapInArrow(run, "word string, n_near long, less long, other string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))


def variant_groups(words: DataFrame, factor: int = FACTOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n, form, form_n, root and n_near of each word of (word, n).

    form: the near word of the largest n (ties: smallest in code-point order),
    if that is at least ``factor`` times the word's; else null.  root: the last
    of the forms that follow each other, the word itself without a form.  n
    grows by ``factor`` from form to form, so few rounds reach every root.
    Repeated words are summed; null words are left out; an empty table gives an
    empty result; other columns are ignored.
    """
    words = written(words.where("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")))
    found = words.join(near_words(words, block_words), "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    found = found.select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    found = written(found)
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # each round doubles the way: a word's root becomes its root's root
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("after"))
        step = written(roots.join(nexts, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts, variants planted by deletion."""
    return variant_groups(vocabulary(docs, deleted_every=DELETED_EVERY))


_CRC = "list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, {0})"
ORACLE = f"""with recursive crc_table as (select list({_CRC.format('b::bigint')} order by b) as crcs from range(256) as bytes(b)),
runs as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{UPPER.lower()}') as run from documents),
once as (select doc_id, run, count(*) as c from runs where length(run) >= {MIN_LENGTH} group by 1, 2),
hashed as (select run, c, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, cast(2 * i + 1 as integer), 2))::bigint), lambda s, x: xor(s >> 8, crcs[xor(s & 255, x) + 1]), 4294967295), 4294967295) as h
 from (select run, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from once), crc_table),
cut as (select case when h % {DELETED_EVERY} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from cut where length(word) >= {MIN_LENGTH} group by 1 having sum(c) >= {MIN_COUNT}),
gaps as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, left(word, i - 1) || chr(1) || substr(word, i + 1) as hole, left(word, i - 1) || substr(word, i + 1) as rest from gaps),
pairs as (select distinct a.word, b.word as other, b.n from holes a join holes b on a.hole = b.hole and a.word <> b.word
 union select distinct h.word, w.word, w.n from holes h join words w on w.word = h.rest
 union select distinct w.word, h.word, h.n from holes h join words w on w.word = h.rest),
near as (select word, count(*) as n_near, max(n) as form_n, arg_min(other, (-n, other)) as form from pairs group by 1),
formed as (select w.word, case when x.form_n >= {FACTOR} * w.n then x.form end as form, w.n, coalesce(x.n_near, 0) as n_near, case when x.form_n >= {FACTOR} * w.n then x.form_n end as form_n from words w left join near x using (word)),
walk as (select word, word as root, form as after from formed union all select k.word, f.word, f.form from walk k join formed f on f.word = k.after)
select f.word, f.form, k.root, f.n, f.n_near, f.form_n from formed f join walk k on k.word = f.word and k.after is null"""
