"""Vectorised byte kernels over Arrow string columns.

A batch of texts is one flat byte buffer with row offsets; every kernel works
on whole buffers with NumPy, so no Python code runs per character or word.
Nulls are empty texts.  Work is cut into slices of about half a megabyte (a longer
text is a slice of its own) to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Longer spans are hashed apart from the polynomial.
LONG_BYTES = 256
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; always at least one row."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, end
        row = end


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buf] * _power(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(buf: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the byte spans [start, end).

    The polynomial of ``prefix`` is sound for short spans only: modulo a power
    of two, certain self-similar strings of over a thousand bytes cancel out for
    every base.  Spans of over LONG_BYTES take BLAKE2b instead, one call each.
    """
    raw = (prefix[end] - prefix[start]) * _power(_BASE_INVERSE, len(prefix))[start]
    out = mix(raw + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_BYTES):
        out[i] = int.from_bytes(blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-byte strings at every position that has one."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[k:] - prefix[:-k]) * _power(_BASE_INVERSE, n))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of non-space bytes."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    full = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~full[:-1]
    after[-1], after[:-1] = True, ~full[1:]
    start = np.flatnonzero(full & (before | edge[:-1]))
    end = np.flatnonzero(full & (after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the \\n-split lines; an empty text has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    rows = np.searchsorted(off, breaks, "right") - 1
    order = np.argsort(np.concatenate([rows * 2 + 1, np.arange(len(off) - 1) * 2]), kind="stable")
    start = np.concatenate([breaks + 1, off[:-1]])[order]
    owner = np.concatenate([rows, np.arange(len(off) - 1)])[order]
    end = np.empty_like(start)
    if len(start):
        end[:-1] = start[1:] - 1
        last = np.append(owner[1:] != owner[:-1], True)
        end[last] = off[owner[last] + 1]
    return start, end, owner


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its leftmost smallest; it depends only on what the window holds."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pad = -len(values) % width
    grid = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    place = np.arange(grid.size).reshape(-1, width)
    # from the left edge of each block the first smallest, from its right edge the one furthest left
    left = np.minimum.accumulate(grid, axis=1)
    fresh = np.ones(grid.shape, bool)
    np.less(left[:, 1:], left[:, :-1], out=fresh[:, 1:])
    left_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    right_at = np.minimum.accumulate(np.where(grid == right, place, grid.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = left.ravel()[width - 1 : width - 1 + n], right.ravel()[:n]
    return np.where(right <= left, right_at[:n], left_at[width - 1 : width - 1 + n])
