"""Exact top-k inner products by columnar branch and bound (operator 3).

Vectors become whole numbers and are packed in blocks in vertical layout, one
row of a block for each dimension.  Every block of queries meets a run of
blocks of candidates in one task, one after another, and keeps its best so far
as the bar for the next.  There inner products grow by a few dimensions at a
time; what the remaining dimensions can add is bounded by the product of the
remaining lengths, and candidates that cannot reach a query's k-th best lower
bound are compacted away.  Blocks have fixed sizes, so memory does not grow
with the data; the best of each run are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_MODULUS = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Blocks of candidates that meet a block of queries one after another.
RUN_BLOCKS = 8
DIMENSIONS_AT_ONCE = 16
SCALE = 64
_LONG = float(2**63 - 1024)


def _pack(ids: np.ndarray, rows: np.ndarray) -> dict:
    """One block: ids, and dimensions as rows."""
    return {"ids": ids.astype("<i8").tobytes(), "n": len(ids), "columns": np.ascontiguousarray(rows.T).astype("<f8").tobytes()}


def _unpack(ids: bytes, n: int, columns: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(columns, "<f8").reshape(-1, n)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-number vectors of the rows that take part, short vectors padded with zeros."""
    ids, lists = [], []
    for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
        if key is None or not vector.is_valid or vector.values.null_count:
            continue
        x = vector.values.to_numpy().astype(np.float64)
        if np.isfinite(x).all():
            ids.append(key)
            lists.append(np.floor(x * SCALE))
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return np.array(ids, np.int64), out


def best_of_block(queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, own: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row) the ids and scores of its ``k`` best among ``best`` and the candidates other than its own id."""
    dims = max(queries.shape[1], columns.shape[0])
    q = np.zeros((len(queries), dims))
    q[:, : queries.shape[1]] = queries
    c = np.zeros((dims, len(ids)))
    c[: columns.shape[0]] = columns
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")  # heavy dimensions first
    q, c = q[:, order], c[order]
    cuts = [*range(0, dims, DIMENSIONS_AT_ONCE), dims]

    def remaining(x: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt((x[:, b:] ** 2).sum(axis=1)) for b in cuts[1:]]

    q_left, c_left = remaining(q), remaining(c.T)
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(ids != own[i])
        known, reached = best[i]
        before = float(reached[-1]) if len(reached) >= k else -np.inf
        score = np.zeros(len(alive))
        for b in range(len(cuts) - 1):
            at = slice(cuts[b], cuts[b + 1])
            part = c[at] if len(alive) == len(ids) else c[at, alive]
            score = score + q[i, at] @ part
            if (len(alive) <= k and before == -np.inf) or not len(alive) or b == len(cuts) - 2:
                continue
            reach = q_left[b][i] * c_left[b][alive] * (1 + 1e-12) + 1e-6
            low = score - reach
            bar = max(before, np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf)
            keep = score + reach >= bar
            alive, score = alive[keep], score[keep]
        if len(alive) > k:
            bar = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= bar
            alive, score = alive[keep], score[keep]
        found, score = np.concatenate([known, ids[alive]]), np.concatenate([reached, np.clip(score, -_LONG, _LONG).astype(np.int64)])
        first = np.lexsort((found, -score))[:k]
        out.append((found[first], score[first]))
    return out


def top_k(vectors: DataFrame, modulus: int = QUERY_MODULUS, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by ``modulus``.  Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id;
    fewer rows where there are fewer candidates.  Components x count as
    floor(64 * x).  Vectors that are null or hold null or non-finite components
    take no part, nor do rows with a null vec_id; rows with the query's own
    vec_id are no candidates; equal query rows are one query, repeated candidates
    count each; shorter vectors are padded with zeros; scores are exact below
    2**53 and saturate at 64 bits; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asks = rows.where((F.col("vec_id") % modulus == 0) & F.col("embedding").isNotNull()).distinct()
    n_asks, n_rows = asks.count(), rows.count()
    slots = max(1, -(-n_asks // query_block))
    salts = max(1, -(-n_rows // (RUN_BLOCKS * candidate_block)))

    def pack_queries(table: pa.Table) -> pa.Table:
        ids, x = _vectors(table.combine_chunks().to_batches()[0])
        return pa.Table.from_pylist([{"slot": table["slot"][0].as_py()} | _pack(ids, x)] if len(ids) else [], schema=pa.schema([("slot", pa.int32()), ("ids", pa.binary()), ("n", pa.int32()), ("columns", pa.binary())]))

    queries = asks.withColumn("slot", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(slots)).cast("int")).groupBy("slot").applyInArrow(pack_queries, "slot int, ids binary, n int, columns binary")
    queries = queries.select("slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "n", "columns")))

    def pack_candidates(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, candidate_block):
                ids, x = _vectors(whole.slice(lo, candidate_block))
                if len(ids):
                    yield pa.RecordBatch.from_pylist([{"salt": int(ids[0] % salts)} | _pack(ids, x)], schema=pa.schema([("salt", pa.int32()), ("ids", pa.binary()), ("n", pa.int32()), ("columns", pa.binary())]))

    blocks = rows.mapInArrow(pack_candidates, "salt int, ids binary, n int, columns binary")
    blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def search(batches):
        now, own, q, best = None, None, None, []

        def found():
            size = [len(a) for a, _ in best]
            if sum(size):
                query = np.repeat(np.arange(len(own)), size) + now[0] * (1 << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size)), pa.array(query), pa.array(np.concatenate([a for a, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "query", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("slot", "salt", "ids", "n", "columns")}
                if now != (row["slot"], row["salt"]):
                    yield from found()
                    now = (row["slot"], row["salt"])
                    own, q = _unpack(*(batch.column(c)[i].as_py() for c in ("q_ids", "q_n", "q_columns")))
                    best = [(np.zeros(0, np.int64),) * 2] * len(own)
                ids, columns = _unpack(row["ids"], row["n"], row["columns"])
                best = best_of_block(q.T, ids, columns, own, k, best)
        yield from found()

    pairs = blocks.join(queries, ["slot", "salt"]).select("slot", "salt", "ids", "n", "columns", "q_ids", "q_n", "q_columns")
    found = pairs.mapInArrow(search, "query_id long, query long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return top_k(vectors)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 20
"""
