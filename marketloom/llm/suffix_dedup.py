"""Exact removal of repeated byte strings with a suffix array (operator 1).

Every string of ``length`` bytes that starts at two or more places of the
corpus is removed wherever it occurs; overlaps count and all strings are judged
on the input.

1. Each string of ``length`` bytes has an anchor, the leftmost of its least
   hashed k-byte grams.  Equal strings have equal anchors at equal places, so
   the strings of one anchor are one short interval of starts, and counting
   anchors tells which intervals can hold a repeat at all.
2. Anchors whose intervals have the same bytes (digests of 128 bits) repeat as
   a whole.  Where an anchor has different intervals, one copy of each goes to
   the suffix sort.
3. The suffix sort is the two-stage one: suffixes smaller than their
   successors are sorted directly (by eight bytes at a time, common parts
   skipped), all others are induced from them by scanning the buckets of first
   bytes from left to right.  Common prefixes of neighbours in the suffix
   array then tell the repeated strings.
4. The intervals come back to their documents, overlapping ones are joined.

Texts move twice, compressed.  No task holds more than an Arrow batch of packed
texts, ``TEXT_BYTES`` of them unpacked (or one text), and ``BATCH_BYTES`` to sort or
``MOST_INTERVALS`` intervals of one anchor: the strings of an anchor with more
distinct intervals are counted one by one, by digests of 128 bits.  Anchors and
intervals with very many rows are split over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import flatten, gram_hash, prefix_hash, slices, sliding_argmin
from .tables import join_bytes, packed, salted_join, unpacked, with_row_key, written
from .tables import parts as fewer

LENGTH = 400
#: Bytes sorted at once; the sort's arrays take some 60 times as much, in each of an executor's Python workers.
BATCH_BYTES = 512 << 10
#: Bytes of whole texts (or one text) that a task works on at once, whatever an Arrow batch has.
TEXT_BYTES = 256 << 10
#: Anchors with more distinct intervals have their strings counted instead of sorted together; the results are the same.
MOST_INTERVALS = 4096
_VOID = np.zeros(0, np.int64)


def anchor_gram(length: int) -> int:
    """Bytes of an anchor: a third of the string's."""
    return max(1, length // 3)


def digests(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of 128 bits, as two longs each, of the spans [start, end)."""
    data, digest = memoryview(x), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def anchor_intervals(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The intervals of string starts by anchor: gram hash, interval digest (two halves), row, first start in the row, number of starts."""
    k = anchor_gram(length)
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in slices(off):
        x, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        inside = np.zeros(len(x) + 1, np.int64)
        long = np.diff(o) >= length
        if not long.any():
            continue
        np.add.at(inside, o[:-1][long], 1)
        np.add.at(inside, o[1:][long] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside)[: len(x) - length + 1] > 0)
        prefix = prefix_hash(x)
        grams = gram_hash(prefix, k)
        anchor = sliding_argmin(grams, length - k + 1)[starts]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(starts)) - 1
        left, right, anchor = starts[first], starts[last], anchor[first]
        piece = digests(x, left, right + length)
        row = np.searchsorted(o, left, "right") - 1
        out.append((grams[anchor].view(np.int64), piece[:, 0], piece[:, 1], row + a, left - o[row], right - left + 1))
    if not out:
        return (_VOID,) * 6
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _direct_order(words, prefix, inverse, at: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """``at`` (string positions, their text ends in ``end``) in the order of the first ``length`` bytes."""

    def key(i: np.ndarray, stop: np.ndarray) -> np.ndarray:
        left = stop - i
        k = words[np.minimum(i, len(words) - 1)].astype(np.uint64)
        short = np.flatnonzero(left < 8)
        if len(short):
            cut = (8 * (8 - np.clip(left[short], 1, 8))).astype(np.uint64)
            k[short] = np.where(left[short] <= 0, 0, (k[short] >> cut) << cut)
        return k

    if not len(at):
        return at
    k = key(at, end)
    order = np.argsort(k, kind="stable")
    k, at, end = k[order], at[order], end[order]
    place = np.arange(len(at), dtype=np.int32)
    new = np.concatenate([[True], k[1:] != k[:-1]])
    depth = np.full(len(at), 8, np.int32)
    done = at.copy()
    while True:
        # only positions that share all bytes so far with a neighbour go on
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied &= depth < length
        if not tied.any():
            return done
        place, at, end, depth, new = place[tied], at[tied], end[tied], depth[tied], new[tied]
        new[0] = True
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        # skip what all of a group share, found by doubling on span hashes
        step = 1 << (length - 1).bit_length() - 1
        while step >= 8:
            i = at + depth
            fits = (depth + step <= length) & (i + step <= end)
            j = np.where(fits, i, 0)
            h = (prefix[j + step * fits] - prefix[j]) * inverse[j]
            same = fits & (h == h[heads][group])
            depth = depth + step * np.logical_and.reduceat(same, heads)[group]
            step >>= 1
        k = key(at + depth, end)
        order = np.lexsort((k, group))
        k, at, end = k[order], at[order], end[order]
        done[place] = at
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (group[1:] != group[:-1])])
        depth = depth + 8


def _rising(x: np.ndarray, n: int, off: np.ndarray) -> np.ndarray:
    """Marks suffixes smaller than their successors; a run of one byte has the type that the byte after it gives."""
    run = np.zeros(n, bool)
    run[1:] = x[1:n] != x[: n - 1]
    run[off[:-1]] = True
    heads = np.flatnonzero(run)
    after = np.append(heads[1:], n)
    ends = np.zeros(n + 1, bool)
    ends[off] = True
    return np.repeat(~ends[after] & (x[after] > x[heads]), after - heads)


def suffix_order(text: np.ndarray, off: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Suffixes that start at ``off[i] .. off[i] + wanted[i] - 1``, in the order of their first ``length`` bytes.

    Two stages: those smaller than their successors are sorted directly, the
    others are induced by scanning buckets.  UTF-8 never holds the byte 255,
    so one is added to every byte and zero ends each text.
    """
    n = len(text)
    x = np.zeros(n + 8, np.uint8)
    x[:n] = text + np.uint8(1)
    words = np.ndarray((n,), ">u8", buffer=x, strides=(1,))
    first, stop = off[:-1], off[1:]
    rises = _rising(x, n, off)
    # beyond the wanted suffixes, those that the last of them are induced from
    next_rise = np.append(np.flatnonzero(rises), n)
    last = first + wanted - 1
    base = np.minimum(next_rise[np.searchsorted(next_rise, last)], stop)
    need = np.zeros(n + 2, np.int32)
    np.add.at(need, first, 1)
    np.add.at(need, np.minimum(base + 1, stop), -1)
    need = np.cumsum(need)[:n] > 0
    starts = np.flatnonzero(need & rises)
    ends_at = stop[np.searchsorted(off, starts, "right") - 1].astype(np.int32)
    direct = _direct_order(words, prefix_hash(x[:n]), _inverse(n + 1), starts.astype(np.int32), ends_at, length)
    induced = need & ~rises
    leads = np.zeros(n + 1, bool)  # positions whose predecessor is induced from them
    leads[1:] = induced
    leads[first] = False
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def deal(order: np.ndarray) -> None:
        before = order[leads[order]] - 1
        if len(before):
            byte = x[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cut = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            for s, e in zip(cut, np.append(cut[1:], len(byte)), strict=True):
                waiting[byte[s]].append(before[s:e])

    # texts whose wanted suffixes reach their end are induced from the empty suffix
    leads_end = (stop[(base == stop) & (wanted > 0)] - 1).astype(np.int32)
    byte = x[leads_end]
    for value in np.unique(byte):
        waiting[value].append(leads_end[byte == value])
    direct_byte = x[direct]
    bounds = np.searchsorted(direct_byte, np.arange(258))
    for value in range(1, 257):
        while waiting[value]:
            order = np.concatenate(waiting[value])
            waiting[value] = []
            out.append(order)
            deal(order)
        order = direct[bounds[value] : bounds[value + 1]]
        if len(order):
            out.append(order)
            deal(order)
    order = np.concatenate(out) if out else _VOID
    keep = np.zeros(n + 2, np.int32)
    np.add.at(keep, first, 1)
    np.add.at(keep, last + 1, -1)
    return order[np.cumsum(keep)[order] > 0]


def _inverse(n: int) -> np.ndarray:
    from .flat import _BASE_INVERSE, _power

    return _power(_BASE_INVERSE, n)


def repeated_starts(text: np.ndarray, off: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Marks the positions among the wanted ones whose ``length`` bytes start at another wanted one too."""
    mark = np.zeros(len(text) + 1, bool)
    order = suffix_order(text, off, wanted, length)
    x = np.zeros(len(text) + 8, np.uint8)
    x[: len(text)] = text
    words = np.ndarray((len(text),), "<u8", buffer=x, strides=(1,))
    a, b = order[:-1], order[1:]
    # common prefixes of neighbours, eight bytes at a time, as far as the length
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        same = words[a + depth] == words[b + depth]
        a, b = a[same], b[same]
    if length < 8:
        same = np.ones(len(a), bool)
        for depth in range(length):
            same &= x[a + depth] == x[b + depth]
        a, b = a[same], b[same]
    mark[a] = True
    mark[b] = True
    return mark


def _runs(mark: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked positions: index of the text, first and last, counted in the text."""
    n = len(mark)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[first + wanted] = True
    before = np.concatenate([[False], mark[:-1]])
    start = np.flatnonzero(mark & (~before | edge[:n]))
    after = np.append(mark[1:], False)
    end = np.flatnonzero(mark & (~after | edge[1:]))
    of = np.searchsorted(first, start, "right") - 1
    return of, start - first[of], end - first[of]


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST_INTERVALS) -> DataFrame:
    """(row_key, spans: sorted array of the joined [start, end) byte spans that repeat) of documents with any."""
    if length < 2:
        raise ValueError("length must be at least 2")
    keyed = with_row_key(docs.select("doc_id", "text"))

    def intervals(batches):
        for batch in batches:
            buf, off = flatten(batch.column("text"))
            for a, b in slices(off, TEXT_BYTES):
                gram, piece, piece2, row, start, n = anchor_intervals(buf[off[a] : off[b]], off[a : b + 1] - off[a], length)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(piece), pa.array(piece2), batch.column("row_key").take(pa.array(row + a)), pa.array(start), pa.array(n)], ["gram", "piece", "piece2", "row_key", "start", "n"])

    found = keyed.select("row_key", "text").mapInArrow(intervals, "gram long, piece long, piece2 long, row_key binary, start long, n long")
    alike = (F.min("piece") == F.max("piece")) & (F.min("piece2") == F.max("piece2"))
    grams = written(found.groupBy("gram").agg(F.count("*").alias("c"), (~alike).alias("mixed")).where("c > 1"))
    repeated = written(salted_join(found, grams, ["gram"], "c", "row_key"))
    mixed = repeated.where("mixed")
    names = ["gram", "piece", "piece2"]
    pieces = written(mixed.groupBy(*names).agg(F.count("*").alias("c"), F.min(F.struct("row_key", "start", "n")).alias("at")))
    kinds = pieces.groupBy("gram").agg(F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("single"))
    kinds = written(kinds.where("single > 0").select("gram", "kinds", (F.col("kinds") > most).alias("many")))
    ask = salted_join(pieces, kinds, ["gram"], "kinds", "piece").select("gram", (F.col("c") == 1).alias("single"), "many", "at.*")

    def cut(batches):
        for batch, texts in unpacked(batches, TEXT_BYTES):
            start, n = (batch.column(c).to_numpy() for c in ("start", "n"))
            part = [t[s : s + m + length - 1] for t, s, m in zip(texts, start, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(part, pa.binary())], [*kept, "part"])

    kept = ("gram", "single", "many", "row_key", "start", "n")
    parts = written(packed(keyed, ["row_key", "text"]).join(ask, "row_key").mapInArrow(cut, "gram long, single boolean, many boolean, row_key binary, start long, n long, part binary"))

    def strings(batches):
        for part in fewer(batches, 64):
            x, off = flatten(part.column("part"))
            n = part.column("n").to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = digests(x, off[of] + at, off[of] + at + length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), part.column("single").take(pa.array(of)), part.column("row_key").take(pa.array(of)), pa.array(part.column("start").to_numpy()[of] + at)], ["h", "h2", "single", "row_key", "s"]
            )

    each = written(parts.where("many").select("single", "row_key", "start", "n", "part").mapInArrow(strings, "h long, h2 long, single boolean, row_key binary, s long"))
    often = written(each.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c > 1"))
    counted = salted_join(each.where("single"), often, ["h", "h2"], "c", "row_key").select("row_key", "s", (F.col("s") + length).alias("e"))

    def sort(batches):
        def solve(tables):
            t = pa.Table.from_batches(tables).combine_chunks()
            text, off = join_bytes([x.as_py() for x in t["part"]])
            n = t["n"].to_numpy()
            of, a, b = _runs(repeated_starts(text, off, n, length)[: len(text)], off[:-1], n)
            single = t["single"].to_numpy()[of]
            of, a, b = of[single], a[single], b[single]
            start = t["start"].to_numpy()[of]
            return pa.RecordBatch.from_arrays([t["row_key"].take(pa.array(of)).combine_chunks(), pa.array(start + a), pa.array(start + b + length)], ["row_key", "s", "e"])

        have, size, tail = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            sizes = np.cumsum(batch.column("n").to_numpy() + length)
            begin = 0
            edges = np.flatnonzero(np.concatenate([[tail is None or gram[0] != tail], gram[1:] != gram[:-1]]))
            for edge in edges:  # a gram's intervals stay together
                here = size + (sizes[edge - 1] if edge else 0) - (sizes[begin - 1] if begin else 0)
                if here >= BATCH_BYTES:
                    if edge > begin:
                        have.append(batch.slice(begin, edge - begin))
                    if have:
                        yield solve(have)
                    have, size, begin = [], 0, edge
            have.append(batch.slice(begin))
            size += sizes[-1] - (sizes[begin - 1] if begin else 0)
            tail = gram[-1]
        if have:
            yield solve(have)

    partial = parts.where("not many").select("gram", "single", "row_key", "start", "n", "part").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, "row_key binary, s long, e long")
    whole = repeated.where("not mixed").select("row_key", "start", "n").union(
        salted_join(mixed, pieces.where("c > 1").select(*names, "c"), names, "c", "row_key").select("row_key", "start", "n")
    ).select("row_key", F.col("start").alias("s"), (F.col("start") + F.col("n") + (length - 1)).alias("e"))
    spans = whole.union(partial).union(counted).groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("raw"))
    return spans


def _without(batches):
    """What is left of packed texts without their ``raw`` spans, and these spans joined."""
    for batch, texts in unpacked(batches, TEXT_BYTES):
        kept, removed = [], []
        for text, raw in zip(texts, batch.column("raw"), strict=True):
            if not raw.is_valid:
                kept.append(text)
                removed.append([])
                continue
            s, e = (raw.values.field(i).to_numpy() for i in (0, 1))
            reach = np.maximum.accumulate(e)
            new = np.concatenate([[True], s[1:] > reach[:-1]])
            s = s[new]
            e = reach[np.append(np.flatnonzero(new)[1:], len(reach)) - 1]
            edges = [0, *np.ravel([s, e], "F").tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)],
            ["doc_id", "n_bytes", "kept", "spans"],
        )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, most: int = MOST_INTERVALS) -> DataFrame:
    """Documents without the bytes of any repeated string of ``length`` bytes.

    Returns doc_id, n_bytes, kept (binary: remaining bytes in order), spans
    (array of removed [start, end) byte spans, joined where they touch or
    overlap).  One row per input row.  A null text is empty; a null doc_id is
    an ordinary document; equal rows repeat each other; texts shorter than
    ``length`` stay whole; an empty table gives an empty result; other columns
    are ignored.
    """
    spans = repeated_spans(docs, length, most)
    keyed = packed(with_row_key(docs.select("doc_id", "text")), ["doc_id", "row_key", "text"])
    return keyed.join(spans, "row_key", "left").select("doc_id", "packed", "raw").mapInArrow(_without, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; then whether anything repeats, and the text that is left.

    ``text`` holds U+FFFD where a removed string began or ended inside a character.
    """
    n_removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return suffix_dedup(docs).select(
        "doc_id",
        "n_bytes",
        n_removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (n_removed > 0).alias("repeats"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
