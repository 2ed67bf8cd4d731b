"""Periodic runs of words, by Lyndon arrays from Baier's grouping and longest common extensions.

A run is a stretch of consecutive words with smallest period q, no shorter than ``LEAST`` and than 2q words, which no
neighbouring word extends. Every run holds a Lyndon word of length q, under the order of words or under its reverse, that
is the longest Lyndon word starting at its first word. So the longest Lyndon word at each word (the Lyndon array),
under both orders, gives all candidates; each is extended to both sides as far as its period holds.

* **Grouping** (first phase of Baier's suffix sorter): words are grouped by value, and groups are taken from the largest to
  the smallest. Each place of a group hands its block to the next smaller place on its left, and places that took the
  same blocks from the same group form a new group right above it. The block that a place has when its group is taken is its
  longest Lyndon word; suffixes are never sorted. The texts of a batch share their groups, blocks never cross texts.
* **Extension**: names of stretches of 2^k words, equal only for equal words (numbered pairs, no hashes), give the common
  extension of two places by descending k. Names end at ``1 << LEVELS`` words; longer extensions repeat that step.

A run of length at least max(L, 2q) repeats L/2 consecutive words or more at distance q. So words that no repeated window of
that many words covers within their text lie in no run, and only the stretches of covered words are grouped. This leaves
out nothing: a run lies in one stretch as a whole.

Nulls: a null text has no words; a null ``doc_id`` is carried. Repeated rows are each returned, with equal results. A text
is never cut; a very long one comes alone in its batch. An empty table gives an empty table. Only the text and the
columns in ``keep`` and ``tile_by`` are read, so other columns cannot clash. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import mixed, split, text_slices

LEAST = 12
#: Names are kept for stretches of up to 2^10 words.
LEVELS = 10


def lyndon_array(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word starting at each place, within strings that begin at ``begins`` (0 first)."""
    n = len(codes)
    lengths = [0] * n
    order = np.argsort(codes, kind="stable")
    borders = np.flatnonzero(np.diff(codes[order])) + 1
    members: list[list[int] | None] = [part.tolist() for part in np.split(order, borders)] if n else []
    ranks = np.empty(n, np.int64)
    ranks[order] = np.repeat(np.arange(len(members)), np.diff(np.concatenate(([0], borders, [n])))) if n else 0
    group = ranks.tolist()
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    before = np.arange(-1, n - 1)
    before[begins] = -1
    left, right = before.tolist(), list(range(1, n + 1))
    own = len(members) - 1
    while own >= 0:
        takers: list[int] = []
        times: list[int] = []
        last = -1
        for i in members[own]:
            if group[i] != own:
                continue  # it moved to a larger group
            r, j = right[i], left[i]
            lengths[i] = r - i
            if r < n and left[r] == i:
                left[r] = j
            if j >= 0:
                right[j] = r
                if j == last:
                    times[-1] += 1
                else:
                    takers.append(j)
                    times.append(1)
                    last = j
        members[own] = None
        if takers:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in zip(takers, times):
                moved.setdefault((-k, group[j]), []).append(j)
            # The more copies of the block, the larger; each new group comes right above the old one.
            for _, old in sorted(moved) if len(moved) > 1 else moved:
                places = moved[_, old]
                new = len(members)
                members.append(places)
                for j in places:
                    group[j] = new
                above = upper[old]
                lower.append(old)
                upper.append(above)
                lower[above] = upper[old] = new
        own = lower[own]
    return np.array(lengths, np.int64)


class Extensions:
    """Longest common extensions of pairs of places, by names of stretches of 2^k codes."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names = [codes]
        while len(self.names) <= LEVELS and 1 << len(self.names) <= longest:
            half, name = 1 << (len(self.names) - 1), self.names[-1].astype(np.int64)
            pairs = name[:-half] * (int(name.max()) + 1) + name[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the stretches that end before ``a`` and ``b`` agree."""
        return self._extend(a, b, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """``a`` < ``b``; the codes around each string differ from all others, so nothing extends beyond it."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            going = np.arange(len(a))
            while len(going):
                x, y = a[going] + step * total[going], b[going] + step * total[going]
                if step < 0:
                    x, y = x - size, y - size
                fits = (x >= 0) & (y < len(names))
                going, x, y = going[fits], x[fits], y[fits]
                going = going[names[x] == names[y]]
                total[going] += size
                if k < len(self.names) - 1:
                    break
        return total


def _stretches(codes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches covered by windows that occur twice in their text."""
    window, n = (least + 1) // 2, len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A wrong match of hashes only adds a stretch.
    key = mixed(codes.astype(np.uint64) + np.uint64(1))
    hashed = text[: n - window + 1].astype(np.uint64)
    for shift in range(window):
        hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + key[shift : n - window + 1 + shift])
    whole = text[: n - window + 1] == text[window - 1 :]
    at = np.flatnonzero(whole)
    at = at[np.argsort(hashed[at], kind="stable")]
    same = hashed[at[1:]] == hashed[at[:-1]]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = np.sort(at[twice])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    covered = np.cumsum(change)[:n] > 0
    first = covered & ~np.concatenate(([False], covered[:-1] & (text[1:] == text[:-1])))
    last = covered & ~np.concatenate((covered[1:] & (text[1:] == text[:-1]), [False]))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (begin, end, period), sorted, of all runs in the texts ``codes[offsets[t]:offsets[t + 1]]``."""
    begins, ends = _stretches(codes, offsets, least)
    long_enough = ends - begins >= least
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return np.empty((0, 3), np.int64)
    sizes = ends - begins
    # Stretches one after the other, with a code of its own in front of each and at the end.
    starts = np.cumsum(sizes + 1) - sizes
    inside = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    origin = np.repeat(begins - starts, sizes)
    found = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    found[inside] = np.unique(codes[inside + origin], return_inverse=True)[1]
    gaps = np.concatenate((starts - 1, [len(found) - 1]))
    found[gaps] = len(found) + np.arange(len(gaps))
    back = np.zeros(len(found), np.int64)
    back[inside] = origin
    extend = Extensions(found, int(sizes.max()))
    runs = []
    for ordered in (found, -found):
        period = lyndon_array(ordered, np.concatenate((gaps, starts)))[inside]
        follows = inside + period
        first = inside - extend.backward(inside, follows)
        end = follows + extend.forward(inside, follows)
        good = end - first >= np.maximum(least, 2 * period)
        runs.append(np.stack((first + back[inside], end + back[inside], period), axis=1)[good])
    return np.unique(np.concatenate(runs), axis=0)


def tiled(codes: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Codes of texts of which those with a mark divisible by ten repeat a part of theirs up to their end.

    With g the tenth of the mark and n words, words from a = g % n on repeat with period 1 + (n - a) // (3 + g % 8).
    """
    index = np.arange(len(codes))
    for text in np.flatnonzero((marks >= 0) & (marks % 10 == 0) & (np.diff(offsets) > 0)).tolist():
        n, g = int(offsets[text + 1] - offsets[text]), int(marks[text]) // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        own = index[offsets[text] + a : offsets[text + 1]]
        own[:] = offsets[text] + a + np.arange(len(own)) % period
    return codes[index]


_FOUND = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_text string, n_words bigint, n_dropped bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def runs_in_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, tile_by: Column | None = None) -> DataFrame:
    """The columns ``keep``, and for each whole text its runs and the text without the repeats.

    ``n_runs``; of the longest run (then the first, then of least period) ``start``, ``length``, ``period`` and ``exponent_milli``,
    a thousand times the length by the period, rounded down (null if there is no run); ``runs_sha256`` of lines
    ``start,length,period`` by start, then period; ``collapsed_text``: words that no run holds after its first period, joined by a space;
    ``n_words``, ``n_dropped`` and all ``runs``. ``tile_by`` is a number for each text: those divisible by ten are first
    repeated as ``tiled`` says, as a test on planted runs; a null changes nothing.
    """
    mark = F.lit(-1).cast("bigint") if tile_by is None else F.coalesce(tile_by.cast("bigint"), F.lit(-1).cast("bigint"))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text"), mark.alias("mark"))
    names = ["row", *(part.split()[0] for part in _FOUND.split(", "))]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            offsets, codes, distinct = split(batch.column("text"))
            codes = tiled(codes, offsets, batch.column("mark").to_numpy(zero_copy_only=False))
            found = find_runs(codes, offsets, least)
            drop = np.zeros(len(codes) + 1, np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 1], -1)
            keeps = np.cumsum(drop)[:-1] == 0
            until = np.concatenate(([0], np.cumsum(keeps)))[offsets]
            words = pa.ListArray.from_arrays(pa.array(until, pa.int32()), distinct.take(pa.array(codes[keeps])))
            size, count = batch.num_rows, np.diff(offsets)
            text = np.searchsorted(offsets, found[:, 0], side="right") - 1
            spans = np.stack((found[:, 0] - offsets[text], found[:, 1] - found[:, 0], found[:, 2]), axis=1)
            digests, longest = [nothing] * size, [(None,) * 4] * size
            bounds = np.searchsorted(text, np.arange(size + 1))
            for t in np.unique(text).tolist():
                own = spans[bounds[t] : bounds[t + 1]].tolist()
                digests[t] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
                s, n, q = min(own, key=lambda r: (-r[1], r[0], r[2]))
                longest[t] = (s, n, q, 1000 * n // q)
            structs = pa.StructArray.from_arrays([pa.array(c) for c in spans.T.copy()], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(np.diff(bounds)), *(pa.array(list(c), pa.int64()) for c in zip(*longest)),
                    pa.array(digests, pa.string()), pc.binary_join(words.cast(pa.list_(pa.string())), " "), pa.array(count), pa.array(count - np.diff(until)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
                ],
                names=names,
            )

    fields = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {fields}, {_FOUND}").select("row.*", *names[1:])
