"""Byte-level BPE encoding and decoding with public ranks (operator 5).

Texts are cut into chunks before each lone space, where every piece of the
tokenizer's pattern begins anew, and the distinct chunks are split by
the pattern.  The distinct new pieces of some megabytes form one corpus, laid out as a chain of
symbols: an inverted index holds the places of every token pair, merges are
applied over the whole corpus in rank order, and each touches only its two
neighbours.  Ids of chunks lie in one flat array, from which those of all texts
are gathered; decoding gathers from one flat buffer of token bytes.  Ranks are
fixed by the vocabulary file; nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import flatten, slices

#: Distinct chunks a worker keeps between batches; beyond it, it starts afresh.
CACHE_CHUNKS = 400_000
#: Texts whose new pieces are merged together, and texts whose ids are gathered together.
CORPUS_BYTES = 8 << 20
GATHER_BYTES = 1 << 20
_NONE = 1 << 40
_PLAIN = np.zeros(256, bool)  # bytes that begin, and if they are ASCII end, no white space
_PLAIN[33:127] = True
_PLAIN[0x80:] = True
_PLAIN[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_workers: dict[str, _Codec] = {}


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the texts that are not empty, and the lone spaces between bytes that are surely no white space.

    Some characters of two or three bytes count as white space here though they
    are none, which only makes chunks longer.
    """
    n = len(buf)
    mark = np.zeros(n + 1, bool)
    at = np.flatnonzero(buf[1:-1] == 0x20) + 1
    before, lead, lead3 = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    multi = (before >= 0x80) & (lead != 0xC2) & ((lead3 < 0xE1) | (lead3 > 0xE3))
    mark[at[_PLAIN[buf[at + 1]] & (multi | ((before > 32) & (before < 127)))]] = True
    mark[off] = True
    return np.flatnonzero(mark[:n])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans ``flat[start : start + size]`` one after another."""
    upto = np.cumsum(size)
    return flat[np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


class _Codec:
    """Vocabulary of one Python worker, and the chunks that it has met."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.ranks = {t: i for i, t in enumerate(tokens) if t is not None}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = rank
        merges[1 << 62] = _NONE  # greater than any pair
        self.pairs = np.array(sorted(merges), np.int64)
        self.pair_ranks = np.array([merges[p] for p in self.pairs.tolist()], np.int64)
        self.token_bytes = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        self.token_size = np.array([len(t or b"") for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {}
        self.piece_ids, self.piece_upto = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.known: dict[bytes, int] = {}
        self.ids, self.upto = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has, merge by merge over all words at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        end = np.cumsum(size)
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        after[end - 1], before[end - size] = -1, -1
        rank_at = np.full(len(ids), _NONE)
        index: dict[int, list[np.ndarray]] = {}  # by token pair: places of its left symbols
        waiting: dict[int, list[int]] = {}  # by rank: the pairs that merge to it, mostly one
        queue: list[int] = []

        def look_up(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Numbers and ranks of the pairs that have one."""
            pair = left << 32 | right
            number = np.searchsorted(self.pairs, pair)
            return number, np.where((right >= 0) & (self.pairs[number] == pair), self.pair_ranks[number], _NONE)

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at these places into the index."""
            follow = after[at]
            number, rank = look_up(ids[at], np.where(follow >= 0, ids[follow], -1))
            rank_at[at] = rank
            at, number = at[rank < _NONE], number[rank < _NONE]
            by = np.argsort(number, kind="stable")
            at, number = at[by], number[by]
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(at) else []
            for s, e in zip(first, [*first[1:], len(at)]):
                pair = int(number[s])
                if pair in index:
                    index[pair].append(at[s:e])
                    continue
                index[pair] = [at[s:e]]
                rank = int(self.pair_ranks[pair])
                if rank not in waiting:
                    waiting[rank] = []
                    heappush(queue, rank)
                waiting[rank].append(pair)

        enter(np.arange(len(ids)))
        while queue:
            rank = heappop(queue)
            at = np.unique(np.concatenate([x for p in waiting.pop(rank) for x in index.pop(p)]))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            # of places that follow one another, every second one from the left
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            follow = after[at]
            beyond, prior = after[follow], before[at]
            merged = np.full(len(at), rank)
            # where a word's first merge makes a pair of lower rank, that one goes before the word's others
            lower = (look_up(merged, np.where(beyond >= 0, ids[beyond], -1))[1] < rank) | ((prior >= 0) & (look_up(ids[prior], merged)[1] < rank))
            lower |= look_up(merged[:1], merged[:1])[1] < rank
            if lower.any():
                again = np.concatenate([[False], word[at[1:]] == word[at[:-1]]])
                wait = again & np.isin(word[at], word[at[lower]])
                if wait.any():
                    enter(at[wait])
                    at, follow, beyond, prior = (x[~wait] for x in (at, follow, beyond, prior))
            ids[at], ids[follow], rank_at[follow] = rank, -1, _NONE
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            prior = before[at]
            enter(np.unique(np.concatenate([at, prior[prior >= 0]])))
        left = ids >= 0
        return ids[left].astype(np.uint32), np.bincount(word[left], minlength=len(words))

    def learn(self, chunks: list[bytes]) -> None:
        """Keeps the ids of new distinct chunks."""
        parts = [self.split(c.decode()) for c in chunks]
        new = sorted(set(chain.from_iterable(parts)).difference(self.pieces))
        if new:
            raw = [p.encode() for p in new]
            whole = np.array([self.ranks.get(r, -1) for r in raw])  # a piece that is a token is not merged
            single = np.flatnonzero(whole >= 0)
            ids, count = self.replay([r for r, x in zip(raw, whole.tolist(), strict=True) if x < 0])
            size = np.ones(len(new), np.int64)
            size[whole < 0] = count
            flat = np.zeros(size.sum(), np.uint32)
            place = np.cumsum(size) - size
            rest = np.ones(len(flat), bool)
            rest[place[single]] = False
            flat[place[single]], flat[rest] = whole[single], ids
            self.pieces.update(zip(new, range(len(self.piece_upto) - 1, len(self.piece_upto) - 1 + len(new)), strict=True))
            self.piece_upto = np.append(self.piece_upto, self.piece_upto[-1] + np.cumsum(size))
            self.piece_ids = np.append(self.piece_ids, flat)
        piece = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int64)
        size = self.piece_upto[piece + 1] - self.piece_upto[piece]
        upto = np.concatenate([[0], np.cumsum(size)])[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
        self.known.update(zip(chunks, range(len(self.upto) - 1, len(self.upto) - 1 + len(chunks)), strict=True))
        self.ids = np.append(self.ids, _gather(self.piece_ids, self.piece_upto[piece], size))
        self.upto = np.append(self.upto, self.upto[-1] + upto)

    def encode(self, buf: np.ndarray, off: np.ndarray):
        """For slices of the rows: first row, row after the last, ids, and where each row's ids begin and the last end."""
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        parts = list(slices(off, GATHER_BYTES))
        starts = [chunk_starts(buf[off[a] : off[b]], off[a : b + 1] - off[a]) + off[a] for a, b in parts]
        at = np.append(np.concatenate(starts), len(buf)) if parts else np.zeros(1, np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(buf)]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        if new:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        first = 0
        for (a, b), part in zip(parts, starts, strict=True):
            here = place[first : first + len(part)]
            first += len(part)
            size = self.upto[here + 1] - self.upto[here]
            count = np.concatenate([[0], np.cumsum(size)])
            yield a, b, _gather(self.ids, self.upto[here], size), count[np.searchsorted(part, off[a : b + 1])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where those of each row begin and the last end."""
        size = self.token_size[ids]
        return _gather(self.token_bytes, self.token_start[ids], size), np.concatenate([[0], np.cumsum(size)])[bounds]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a public rank file (base64 token, rank); bounded by the vocabulary."""
    tokens: list[bytes] = []
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens += [None] * (int(rank) + 1 - len(tokens))
                tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes that lie one after another."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, decoded: bool = False) -> DataFrame:
    """Token ids of every text, and with ``decoded`` the bytes that they decode to.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers),
    and decoded.  One row per input row; a null text is empty, an empty text
    has no tokens, a null doc_id stays; equal rows have equal ids; text that
    spells a special token is ordinary text; an empty table gives an empty
    result; other columns are ignored.  ``pattern`` must begin a new piece at
    each space that stands alone between characters other than white space, as
    patterns of byte-level vocabularies do.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokens)  # the vocabulary, whose size is fixed
    name = hashlib.md5(b"\0".join(t or b"" for t in tokens) + pattern.encode()).hexdigest()
    columns = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches):
        codec = _workers.get(name)
        if codec is None:
            codec = _workers[name] = _Codec(shared.value, pattern)
        for batch in batches:
            buf, off = flatten(batch.column("text"))
            found = ((lo + a, lo + b, *rest) for lo, hi in slices(off, CORPUS_BYTES) for a, b, *rest in codec.encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            for a, b, ids, bounds in found:
                out = [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)), _binary(ids.astype("<u4"), 4 * bounds)]
                if decoded:
                    out.append(_binary(*codec.decode(ids, bounds)))
                yield pa.RecordBatch.from_arrays(out, columns)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def public_encoder(file: str = "byte_bpe_multi_50k.tiktoken") -> tuple[list[bytes], str]:
    """Tokens and pattern of a public byte-level vocabulary, by its file name."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(file)), public_tokenizers.PATTERN


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, *public_encoder(), decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
