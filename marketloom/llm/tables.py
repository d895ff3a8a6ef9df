"""Shared storage, packing and graph helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import shared_folder, written  # noqa: F401 (the corpus operators take them from here)
from .flat import slices


def parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, which bounds what Python holds at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def row_key() -> Column:
    """A digest of 128 bits of doc_id and text: rows alike in both, nulls among them, share it."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.concat(F.lit("+"), F.col("text")), F.lit("")))
    return F.unhex(F.md5(key)).alias("row_key")


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds ``row_key``."""
    return docs.withColumn("row_key", row_key())


#: Keys that hold more than one in so many of the rows are split over several tasks; there are at most as many.
HOT_PARTS = 2000


def salted_join(rows: DataFrame, right: DataFrame, keys: list[str], count: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``right``, which has each key once and in ``count`` its number of rows; ``count`` is dropped.

    Rows of a key with over 1 / HOT_PARTS of all rows are dealt by a hash of
    ``spread`` over as many salts as bring them below that share, and the key's
    row of ``right`` is repeated as often.  So many keys there can be at most
    HOT_PARTS of, which bounds the broadcast of their names; all rows stay.
    ``right`` should be a written table, as it is read twice.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    part = total // HOT_PARTS + 1
    salts = F.ceil(F.col(count) / part)
    hot = right.where(F.col(count) > part).select(*keys, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    again = F.when(F.col(count) > part, F.sequence(F.lit(0), (salts - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(again)).drop(count), [*keys, "_salt"], how).drop("_salt")


#: Up to so many rows of keys and flags are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small_or_shuffled(right: DataFrame) -> DataFrame:
    """A written table of keys and flags with the hint that suits its counted size."""
    return F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right.hint("shuffle_hash")


def packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the text compressed as ``packed``; shuffles of whole texts move half as much."""
    kinds = dict(docs.dtypes)
    names = [c for c in columns if c != "text"]

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in parts(batches, 256):
            text = batch.column("text").cast(pa.large_binary())
            rows = [compressor.compress(x.as_buffer()) if x.is_valid else None for x in text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.binary())], [*names, "packed"])

    return docs.select(*names, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "packed binary"]))


def unpack(column: pa.Array) -> list[bytes]:
    """The texts of ``packed``; null is an empty text."""
    decompressor = zstandard.ZstdDecompressor()
    return [decompressor.decompress(x.as_buffer()) if x.is_valid else b"" for x in column]


def unpacked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in slices of about ``limit`` bytes of texts, at least a row, and the texts of ``packed``."""
    for batch in batches:
        off = np.zeros(batch.num_rows + 1, np.int64)
        np.cumsum([zstandard.frame_content_size(x.as_buffer()) if x.is_valid else 0 for x in batch.column("packed")], out=off[1:])
        for a, b in slices(off, limit):
            part = batch.slice(a, b - a)
            yield part, unpack(part.column("packed"))


def join_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One flat buffer and its offsets."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b: long).

    Returns (node, root), root being the smallest node of the component, for
    each node of an edge.  Each round replaces the edges by stars: larger
    neighbours are linked to the smallest neighbour, then smaller ones to it.
    Rounds grow with the logarithm of the component size; tables between them
    are written to the shared folder and nothing is collected but one flag.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select("a", F.col("low").alias("b")).union(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        after = written(small)
        heads = after.select("b").distinct()
        # stars are final when no centre is itself a leaf and no leaf has two centres
        moving = after.join(heads.withColumnRenamed("b", "a"), "a", "left_semi").limit(1).count() or after.groupBy("a").count().where("count > 1").limit(1).count()
        stars = after
        if not moving:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(heads.select(F.col("b").alias("node"), F.col("b").alias("root")))
