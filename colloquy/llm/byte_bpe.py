"""Byte-level BPE encoding and decoding with padded numpy matrices.

A task collects the distinct pieces of a batch of whole texts, puts them into matrices by byte
length, and merges all rows of a matrix at once: each round, every row merges its leftmost pair of
minimum rank, rows without a pair leave, and the matrix loses a column. Ranks of pairs come from an
open-addressing hash table. The result equals the sequential algorithm, piece by piece.

Nulls: a null text is an empty one and has no ids; a null ``doc_id`` is carried. Repeated rows are encoded
each. Very long pieces (over ``LONG_PIECE`` bytes) would make wide, nearly empty matrices and go
through a heap of pairs instead, with the same result. Empty tables give empty tables. Only
``doc_id``, ``text`` and the columns named in ``keep`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import text_slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG_PIECE = 1024
#: Distinct pieces that a worker remembers between batches; beyond it, it starts anew.
REMEMBERED = 200_000

NONE = np.int32(np.iinfo(np.int32).max)
PAD = np.int32(-1)


class PairTable:
    """Rank of the token that two adjacent tokens make, by linear probing over packed keys."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, merged in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(merged)
        keys = self._keys(np.array(left, np.int32), np.array(right, np.int32))
        values = np.array(rank, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.full(1 << self.bits, NONE)
        waiting, slots = np.arange(len(keys)), self._slots(keys)
        while len(waiting):
            free = self.keys[slots] == self.EMPTY
            first = np.unique(slots[free], return_index=True)[1]
            placed = np.flatnonzero(free)[first]
            self.keys[slots[placed]] = keys[waiting[placed]]
            self.values[slots[placed]] = values[waiting[placed]]
            rest = np.ones(len(waiting), bool)
            rest[placed] = False
            waiting, slots = waiting[rest], self._next(slots[rest])

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where there is none; any shape."""
        keys = self._keys(left, right).ravel()
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != self.EMPTY))
        slots = slots[open_]
        while len(open_):
            slots = self._next(slots)
            found = self.keys[slots]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            going = ~hit & (found != self.EMPTY)
            open_, slots = open_[going], slots[going]
        return out.reshape(left.shape)


class Codec:
    """Ranks of a vocabulary, with the encoder and decoder built from them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.pieces = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = dict(zip(ranks.values(), ranks.keys()))
        self.token_text = [str(i) for i in range(max(self.token_bytes) + 1)]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = [self.pieces.findall(text) for text in texts]
        ends = np.cumsum([len(pieces) for pieces in split], dtype=np.int64)
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        del split
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn([piece for piece in distinct if piece not in self.known])
        each = list(map(self.known.__getitem__, distinct))
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        starts = np.cumsum(lengths) - lengths
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(lengths.sum()))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # Ids of all pieces in order: each piece contributes the run that starts at its own place.
        sizes = lengths[codes]
        until = np.concatenate(([0], np.cumsum(sizes)))
        ids = flat[np.repeat(starts[codes] - until[:-1], sizes) + np.arange(until[-1])]
        bounds = until[np.concatenate(([0], ends))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decimal(self, ids) -> str:
        return " ".join(map(self.token_text.__getitem__, ids))

    def _learn(self, pieces: list[str]) -> None:
        known, ranks = self.known, self.ranks
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (whole := ranks.get(raw)) is not None:
                known[piece] = (whole,)
            elif len(raw) > LONG_PIECE:
                known[piece] = tuple(self._merge_long(raw))
            else:
                by_length.setdefault((len(raw) + 3) // 4, []).append((piece, raw))
        for width, bucket in by_length.items():
            matrix = self._matrix([raw for _, raw in bucket], width * 4)
            for (piece, _), ids in zip(bucket, self._merge(matrix)):
                known[piece] = ids

    def _matrix(self, raws: list[bytes], width: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), np.uint8).reshape(-1, width)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        return np.where(np.arange(width) < lengths[:, None], self.of_byte[flat], PAD)

    def _merge(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """One round merges one pair in each remaining row; rows without a pair are done."""
        out: list[tuple[int, ...]] = [()] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            every = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[every, at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                lines = ids[done]
                real = lines >= 0
                flat, ends = lines[real].tolist(), np.cumsum(real.sum(axis=1)).tolist()
                for row, start, end in zip(rows[done].tolist(), [0, *ends], ends):
                    out[row] = tuple(flat[start:end])
                go = ~done
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, at] = best
            ids = _without(ids, every, at + 1)
            ranks = _without(ranks, every, at)
            for where, left in ((np.flatnonzero(at > 0), -1), (np.flatnonzero(at < ranks.shape[1]), 0)):
                col = at[where] + left
                ranks[where, col] = self.pairs.rank(ids[where, col], ids[where, col + 1])
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        first = self.pairs.rank(ids[:-1], ids[1:])
        ids, heap = ids.tolist(), [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        token_bytes, ranks = self.token_bytes, self.ranks

        def pair(i: int) -> int | None:
            j = after[i]
            return ranks.get(token_bytes[ids[i]] + token_bytes[ids[j]]) if j < len(ids) else None

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] is None or pair(i) != rank:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = rank, None, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [i for i in ids if i is not None]


def _without(matrix: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The matrix less one element of each row."""
    keep = np.ones(matrix.shape, bool)
    keep[rows, at] = False
    return matrix[keep].reshape(len(matrix), -1)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def encode(
    docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` and ``token_ids`` of each whole text; ``path`` names a rank file all workers have."""
    rows = docs.select(*keep, F.col("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_slices(batches):
            ids = pa.array(own.encode(batch.column("text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), ids], names=[*(f.name for f in kept), "token_ids"]
            )

    return rows.mapInArrow(run, _schema(kept, "token_ids array<int>"))


def decode(
    encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` and ``decoded``, the bytes that ``token_ids`` stand for."""
    rows = encoded.select(*keep, "token_ids")
    kept = [f for f in rows.schema.fields if f.name != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = pa.array([own.decode(ids or ()) for ids in batch.column("token_ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), raw], names=[*(f.name for f in kept), "decoded"]
            )

    return rows.mapInArrow(run, _schema(kept, "decoded binary"))


def round_trip(
    docs: DataFrame,
    path: str = RANKS,
    pattern: str = public_tokenizers.PATTERN,
    keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
) -> DataFrame:
    """Encode and decode each whole text in one pass and return counts and digests only.

    Columns: ``keep``, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by a space, and
    ``decoded_sha256`` of the bytes the ids decode to. Nothing but these leaves the worker, and ``token_ids`` if asked for.
    """
    rows = docs.select(*keep, F.col("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_slices(batches):
            counts, of_ids, of_bytes = [], [], []
            encoded = own.encode(batch.column("text").to_pylist())
            for array in encoded:
                ids = array.tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(own.decimal(ids).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            if with_ids:
                columns.append(pa.array(encoded, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *more])

    more = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    types = ["bigint", "string", "string"] + ["array<int>"] * with_ids
    return rows.mapInArrow(run, _schema(kept, ", ".join(f"{n} {t}" for n, t in zip(more, types))))


def decoded_text(raw: Column) -> Column:
    """Decoded bytes as text."""
    return F.decode(raw, "UTF-8")


def _schema(kept, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), more])
