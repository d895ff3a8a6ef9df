"""Removal of lines shared with earlier documents by pairwise alignment (operator 7).

Documents that share a block are found through hashes of its shortest runs of
adjacent lines that reach enough bytes: a document is linked to the first
holder of each such run, so each shared block meets, run by run, documents
that hold it whole, and links grow with the lines.  Each linked pair is aligned
with patience diff: lines unique on both sides, their longest increasing chain,
equal neighbours around it, and the gaps again.  Aligned blocks of enough bytes
go from the later document, and so do repeated or moved runs that the diff
passes over.  Documents are judged on their input, not on what is left.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import SPACE, flatten, lines, prefix_hash, slices, span_hash
from .tables import packed, parts, row_key, salted_join, unpack, with_row_key, written

#: A block with fewer bytes other than white space stays, unless it is the whole later document.
BLOCK_BYTES = 8


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of equal items, increasing on both sides."""
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict[int, list[int]] = {}
        for side, (items, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                seen = where.setdefault(items[i], [0, 0, 0, 0])
                seen[side] += 1
                seen[2 + side] = i
        once = [(i, j) for n, m, i, j in where.values() if n == m == 1]
        if not once:
            continue
        once.sort()
        # the longest increasing chain of places in b
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for at, (_, j) in enumerate(once):
            p = bisect_left(tops, j)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(j)
                piles.append(at)
            else:
                tops[p], piles[p] = j, at
        chain = []
        at = piles[-1]
        while at >= 0:
            chain.append(once[at])
            at = back[at]
        chain.reverse()
        found += chain
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(found)


def shared_blocks(later: list[int], earlier: list[int], size: list[int], least: int) -> list[int]:
    """Lines of the later document in aligned blocks of at least ``least`` bytes, or in one that is all of it."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if block and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(size[x] for x in block) >= least or len(block) == len(later):
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def shared_runs(starts: list[int], ends: list[int], runs: list[int], known: set[int], n: int) -> list[int]:
    """Lines of the runs [start, end) that are known."""
    depth = [0] * (n + 1)
    for s, e, h in zip(starts, ends, runs, strict=True):
        if h in known:
            depth[s] += 1
            depth[e] -= 1
    return np.flatnonzero(np.cumsum(depth[:n]) > 0).tolist() if n else []


def block_runs(size: np.ndarray, row: np.ndarray, rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lines that stand for blocks, as (row, start, end), and those that only answer for short documents.

    From each line, and up to each line, the shortest run of ``least`` bytes:
    together they cover every line of any block of so many bytes, and which
    runs a block has depends on the block alone.  A document with fewer bytes
    asks for one run, itself without blank lines around it; the runs that could
    hold one are the others.
    """
    count = np.bincount(row, minlength=rows)
    last = np.cumsum(count)
    first = last - count
    upto = np.concatenate([[0], np.cumsum(size)])
    line = np.arange(len(size))
    fore = np.searchsorted(upto, upto[:-1] + least, "left")
    back = np.searchsorted(upto, upto[1:] - least, "right") - 1
    ok, ok2 = fore <= last[row], (back >= first[row]) & (upto[1:] >= least)
    s, e = np.concatenate([line[ok], back[ok2]]), np.concatenate([fore[ok], line[ok2] + 1])
    text = np.flatnonzero(size > 0)
    total = upto[last] - upto[first]
    short = np.flatnonzero((total > 0) & (total < least))
    left = text[np.searchsorted(text, first[short])]
    right = text[np.searchsorted(text, last[short]) - 1]
    s, e = np.concatenate([s, left]), np.concatenate([e, right + 1])
    pair = np.unique(np.stack([s, e], axis=1), axis=0)
    held = [np.zeros((0, 2), np.int64)]
    for k in range(least - 1):
        i, j = text[: len(text) - k], text[k:]
        fits = (row[i] == row[j]) & (upto[j + 1] - upto[i] < least)
        held.append(np.stack([i[fits], j[fits] + 1], axis=1))
        if len(text) <= k + 1:
            break
    other = np.concatenate(held)
    return row[pair[:, 0]], pair[:, 0], pair[:, 1], row[other[:, 0]], other[:, 0], other[:, 1]


def _lined(keyed: DataFrame, least: int) -> DataFrame:
    """Line hashes and sizes of each document, and the runs by which it is linked."""
    fields = {"hashes": "long", "sizes": "int", "starts": "int", "ends": "int", "runs": "long", "held": "long"}

    def run(batches):
        for batch in parts(batches, 1024):
            buf, off = flatten(batch.column("text"))
            found, counts = [], []
            for lo, hi in slices(off):
                x, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                a, b, row = lines(x, o)
                full = np.zeros(len(x) + 1, np.int64)
                np.cumsum(~SPACE[x], out=full[1:])
                size, prefix = full[b] - full[a], prefix_hash(x)
                r, s, e, r2, s2, e2 = block_runs(size, row, hi - lo, least)
                order = np.argsort(r2, kind="stable")
                r2, s2, e2 = r2[order], s2[order], e2[order]
                count = np.bincount(row, minlength=hi - lo)
                first = np.cumsum(count) - count
                # a run is the bytes from its first line to its last, line breaks among them
                hashed = [span_hash(x, prefix, a[u], b[v - 1]).view(np.int64) for u, v in ((s, e), (s2, e2))]
                # a short document goes with the blank lines around its run
                short = np.bincount(row, size, hi - lo)[r] < least
                s, e = np.where(short, 0, s - first[r]), np.where(short, count[r], e - first[r])
                found.append((span_hash(x, prefix, a, b).view(np.int64), size, s, e, *hashed))
                n, m = np.bincount(r, minlength=hi - lo), np.bincount(r2, minlength=hi - lo)
                counts.append((count, count, n, n, n, m))
            if not found:
                continue
            arrays = []
            for kind, values, count in zip(fields.values(), zip(*found, strict=True), zip(*counts, strict=True), strict=True):
                at = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(count))]), pa.int32())
                arrays.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(values).astype(np.int64 if kind == "long" else np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *arrays], ["doc_id", "row_key", *fields])

    kind = dict(keyed.dtypes)["doc_id"]
    return keyed.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {kind}, row_key binary" + "".join(f", {k} array<{v}>" for k, v in fields.items()))


def shared_lines(keyed: DataFrame, least: int = BLOCK_BYTES) -> DataFrame:
    """(row_key, gone: sorted line numbers that an earlier document holds) of documents with any."""
    # equal rows share a key and lose the same lines; written as they are, so that joins shuffle apart from the aggregate
    once = written(_lined(keyed.where("doc_id is not null"), least).dropDuplicates(["row_key"]))
    me = F.struct("doc_id", "row_key")
    asks = once.select("doc_id", "row_key", F.explode(F.array_distinct("runs")).alias("run"))
    answers = once.where("size(held) > 0").select("doc_id", "row_key", F.explode(F.array_distinct("held")).alias("run"))
    hold = asks.select("*", F.lit(1).alias("asked")).union(answers.select("*", F.lit(0).alias("asked")))
    first = written(hold.groupBy("run").agg(F.count("*").alias("holders"), F.sum("asked").alias("asked"), F.min(me).alias("first")).where("holders > 1 and asked > 0").select("run", "holders", "first"))
    links = salted_join(asks, first, ["run"], "holders", "row_key").where("first.row_key <> row_key").select("row_key", F.col("first.row_key").alias("partner"))
    links = written(links.distinct())
    mine = links.join(once.select("row_key", "hashes", "sizes", "starts", "ends", "runs"), "row_key")
    # a partner of many documents, such as the first holder of a very common line, is split over tasks
    asked = links.groupBy("partner").agg(F.count("*").alias("links"))
    theirs = once.select(F.col("row_key").alias("partner"), F.col("hashes").alias("theirs"), F.concat("runs", "held").alias("known")).join(asked, "partner")
    both = salted_join(mine, theirs, ["partner"], "links", "row_key")

    def align(batches):
        names = ("row_key", "hashes", "theirs", "sizes", "starts", "ends", "runs", "known")
        for batch in parts(batches):
            keys, *columns = (batch.column(c) for c in names)
            gone = []
            for a, b, n, s, e, r, known in zip(*(c.to_pylist() for c in columns), strict=True):
                gone.append(sorted({*shared_blocks(a, b, n, least), *shared_runs(s, e, r, set(known), len(a))}))
            yield pa.RecordBatch.from_arrays([keys, pa.array(gone, pa.list_(pa.int32()))], ["row_key", "gone"])

    pairs = both.select("row_key", "hashes", "theirs", "sizes", "starts", "ends", "runs", "known").mapInArrow(align, "row_key binary, gone array<int>")
    return pairs.where("size(gone) > 0").groupBy("row_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def line_dedup(docs: DataFrame, least: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with aligned lines of earlier documents deleted from ``text``.

    Adds n_lines and n_removed (``\\n``-split lines before, and deleted); other
    columns stay.  Earlier is the smaller doc_id, then the smaller row key.  A
    null text stays null and has no lines; rows with a null doc_id stay whole
    and are nobody's earlier document; rows equal in doc_id and text lose the
    same lines; an empty table gives an empty result.  Clashing names: the
    added columns replace those of ``docs``.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = with_row_key(docs.select("doc_id", "text"))
    gone = shared_lines(keyed, least)
    # other columns travel in one struct, so that their names clash with none
    others = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in names if c != "text")).alias("others")
    small = packed(docs.select(row_key(), "text", others), ["row_key", "others"])

    def cut(batches):
        for batch in parts(batches):
            texts, n_lines, n_removed = [], [], []
            valid = batch.column("packed").is_valid().to_pylist()
            for text, drop, ok in zip(unpack(batch.column("packed")), batch.column("gone").to_pylist(), valid, strict=True):
                rows = text.split(b"\n") if ok else []
                n_lines.append(len(rows))
                n_removed.append(len(drop or ()))
                if drop:
                    out = set(drop)
                    text = b"\n".join(p for i, p in enumerate(rows) if i not in out)
                texts.append(text if ok else None)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column("others").field(c) for c in names), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_lines", "n_removed"]
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_lines long, n_removed long"])
    return small.join(gone, "row_key", "left").mapInArrow(cut, schema)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining text)."""
    found = line_dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
