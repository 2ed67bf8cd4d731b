"""Words of whole texts inside a task, as flat arrays.

A word is a maximal run of characters outside space, tab, line feed, vertical tab, form feed and
carriage return. Batches are cut by bytes of text, so a task holds a bounded amount besides its
single longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The six ASCII space characters, as a character class for regular expressions.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

#: Bytes of text handled at once in a task.
BATCH_BYTES = 2 << 20


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text comes alone.

    Small batches are joined, large ones are cut. Null texts become empty ones.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at), ""))
        sizes = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(sizes, done + limit - size, side="right"))
            if end <= start:
                if held:
                    yield _joined(held)
                    held, size = [], 0
                    continue
                end = start + 1
            held.append(batch.slice(start, end - start))
            size += int(sizes[end - 1]) - done
            done, start = int(sizes[end - 1]), end
            if start < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)
    held.clear()
    pa.default_memory_pool().release_unused()  # workers stay, and share their executor's memory


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: offsets of the texts, a code for each word, and the distinct words."""
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return offsets, codes, distinct


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


#: Bytes up to which a word is hashed eight at a time for all words at once.
SHORT = 256
#: What the hashes of words of up to ``SHORT`` bytes begin with, and the bytes that are a word's of eight.
_SEEDS = [mixed(np.arange(SHORT + 1, dtype=np.uint64) + np.uint64(x)) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lanes(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit hash (XXH3) of each word's UTF-8 bytes."""
    if not len(distinct):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    raw = b"".join(map(xxhash.xxh3_128_digest, distinct.cast(pa.binary()).to_pylist()))
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def chunk_lanes(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word's UTF-8 bytes, scrambled anew after every eight bytes; XXH3's halves for long words."""
    if not len(distinct):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    _, places, data = distinct.cast(pa.string()).buffers()
    offsets = np.frombuffer(places, np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offsets[-1])[offsets[0] :]
    offsets = offsets - offsets[0]
    one, two = lanes_at(np.concatenate((raw, np.zeros(8, np.uint8))), offsets[:-1], np.diff(offsets))
    return one, two


def lanes_at(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """``chunk_lanes`` of the words at these places of ``raw``, which has eight bytes more than its text."""
    found, left, done, more = [seed[np.minimum(sizes, SHORT)] for seed in _SEEDS[:halves]], slice(None), 0, sizes > 0
    if not more.all():
        left = np.flatnonzero(more)
    while done == 0 or len(left):
        chunk, more = _eight(raw, starts[left] + done, sizes[left] - done)
        found[0][left] = mixed(found[0][left] ^ chunk) + np.uint64(0x165667B19E3779F9)
        if halves > 1:
            found[1][left] = mixed(found[1][left] + mixed(chunk * np.uint64(0x27D4EB2F165667C5)))
        left = np.flatnonzero(more & (sizes <= SHORT)) if isinstance(left, slice) else left[more]
        done += 8
    for i in np.flatnonzero(sizes > SHORT):
        for half, value in zip(found, np.frombuffer(xxhash.xxh3_128_digest(raw[starts[i] : starts[i] + sizes[i]].tobytes()), "<u8")):
            half[i] = value
    return found


def _eight(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next eight bytes of words with so many left, zeros behind their ends, and whether more follow."""
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[at] & _MASKS[np.minimum(sizes, 8)], sizes > 8


def alike(values: np.ndarray) -> np.ndarray:
    """For each value the index of one that is equal, the same for all that are equal."""
    out = left = np.arange(len(values), dtype=np.int32)
    own, turn = values, 0
    while len(left):
        # The values of a slot name one of them; those that differ from it go to other slots of the next turn.
        bits, turn = max(4, len(left).bit_length() - 1), turn + 1
        slot = (own * (mixed(np.array([turn], np.uint64)) | np.uint64(1))) >> np.uint64(64 - bits)
        named = np.empty(1 << bits, np.int32)
        named[slot] = left
        named = named[slot]
        if turn == 1:
            out = named
        else:
            out[left] = named
        left = left[values[named] != own]
        own = values[left]
    return out


class Words:
    """Words of texts without nulls, by their places in ``raw``; they never become strings.

    ``heads`` are the first line of each text and the number of all, ``offsets`` the first word of each line and the number of all.
    """

    def __init__(self, texts: pa.Array):
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string())), "\n")
        size = pc.binary_length(whole)[0].as_py()
        self.raw = np.zeros(size + 8, np.uint8)
        raw = self.raw[:size]
        if size:
            raw[:] = np.frombuffer(whole.buffers()[2], np.uint8, size)
        feeds = np.flatnonzero(raw == 10)
        begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[:-1]
        self.heads = np.concatenate(([0], np.searchsorted(feeds, begin), [len(feeds) + 1]))
        space = np.ones(size + 2, bool)
        np.logical_or(raw == 32, raw - np.uint8(9) < 5, out=space[1:-1])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.sizes = edges[::2].copy(), edges[1::2] - edges[::2]
        self.offsets = np.concatenate(([0], np.searchsorted(self.starts, feeds), [len(self.starts)]))

    def hashes(self) -> np.ndarray:
        """The first hash (``chunk_lanes``) of every word, repeated ones too."""
        return lanes_at(self.raw, self.starts, self.sizes, 1)[0]

    def coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A code for each word, and the two hashes (``chunk_lanes``) of the distinct words."""
        raw, starts, sizes = self.raw, self.starts, self.sizes
        value, more = _eight(raw, starts, sizes)
        long, done = np.flatnonzero(more), 8
        left = long[sizes[long] <= SHORT]
        while len(left):
            chunk, more = _eight(raw, starts[left] + done, sizes[left] - done)
            value[left] = mixed(value[left]) ^ chunk
            left, done = left[more], done + 8
        codes = alike(value)
        # Words that differ from the one they were taken for, and very long ones, are told apart by their bytes.
        unlike = sizes[codes] != sizes
        unlike[long] |= sizes[long] > SHORT
        left, done = long[~unlike[long]], 0
        while len(left):
            (chunk, more), (other, _) = (_eight(raw, starts[at] + done, sizes[at] - done) for at in (left, codes[left]))
            unlike[left[chunk != other]] = True
            left, done = left[more], done + 8
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(unlike):
            codes[i] = known.setdefault(raw[starts[i] : starts[i] + sizes[i]].tobytes(), i)
        real = np.zeros(len(codes), bool)
        real[codes] = True
        at = np.flatnonzero(real)
        return (np.cumsum(real) - 1)[codes], *lanes_at(raw, starts[at], sizes[at])
