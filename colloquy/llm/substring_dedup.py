"""Words of long passages that occur more than once, found over a sparse De Bruijn graph.

A window is ``WINDOW`` consecutive words of one text; it is repeated if its words also start anywhere else, in the same
text too. Of all k-mers of ``K`` words only anchors become edges: a window's anchor is its k-mer of least hash
(the leftmost), so equal windows have equal anchors at equal places. All windows of an anchor's occurrence form its
stretch. An edge that occurs once is dropped. An edge whose stretches are all equal does not branch: its
occurrences are one path, and all their windows are repeated, with nothing more to compare. A branching edge's windows
are compared one by one, by their source coordinates: all its occurrences return their windows' 128-bit hashes, and those
counted twice are repeated. Joins on the edges bring the verdicts back to the occurrences.

Between the two passes over the texts a filter of fixed size (two bits for each of ``FILTER`` hash values) tells which
anchors may repeat or branch; the joins settle what it lets through, so it changes only how much is shuffled.

Nulls: a null text has no words; a null ``doc_id`` is carried. Repeated rows (same id and text) repeat each other's
windows, as any two copies do. Texts shorter than a window keep all words. Long texts are one row and handled alone. An
empty table gives an empty table. Columns travel in a struct, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.store import written
from colloquy.llm.words import WORD, lanes, mixed, split, text_slices

WINDOW = 35
K = 8
FILTER = 1 << 24
SLICE = 3 << 20
_CHUNK = 1 << 18
_STEP = 1 << 15

_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Rolling:
    """Hashes of any stretch of a word sequence: differences of prefix sums of a polynomial modulo 2^64."""

    def __init__(self, words: np.ndarray, base: int):
        powers = np.full(len(words) + 1, base, np.uint64)
        inverse = np.full(len(words) + 1, pow(base, -1, 2**64), np.uint64)
        powers[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers)[:-1])))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start])


class Stretches:
    """Anchors of a batch: text, first and last window, the anchor's hash and the stretch's."""

    def __init__(self, texts: pa.Array, window: int, k: int):
        offsets, codes, distinct = split(texts)
        self.window = window
        words, others = (lane[codes] for lane in lanes(distinct))
        total, wide = len(words), window - k + 1
        self.text = self.start = self.end = np.empty(0, np.int64)
        self.anchor = self.context = np.empty(0, np.uint64)
        if total < window:
            return
        # Two rolling hashes on unlike halves of the words' hashes: together 128 bits.
        self.rolling, self.other = Rolling(words, _FIRST), Rolling(others, _SECOND)
        kmers = self.rolling.of(np.arange(total - k + 1), k)
        of_text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        starts = np.flatnonzero(of_text[: total - window + 1] == of_text[window - 1 :])
        if not len(starts):
            return
        view = np.lib.stride_tricks.sliding_window_view(kmers, wide)
        least = np.concatenate([view[i : i + _STEP].argmin(axis=1) for i in range(0, len(view), _STEP)])
        at = starts + least[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (of_text[starts[1:]] != of_text[starts[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        self.first, self.last = starts[first], starts[last]
        self.text = of_text[self.first]
        self.anchor = kmers[at[first]]
        shape = (at[first] - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        self.context = mixed(self.other.of(self.first, self.last - self.first + window) ^ mixed(shape))
        # Word numbers within the text.
        self.start, self.end = self.first - offsets[self.text], self.last - offsets[self.text]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the windows of some stretches: stretch, number of the first word in its text, and both hashes."""
        sizes = self.last[which] - self.first[which] + 1
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(self.first[which], sizes) + inside
        return np.repeat(which, sizes), np.repeat(self.start[which], sizes) + inside, self.rolling.of(at, self.window), self.other.of(at, self.window)


def edges(keyed: DataFrame, window: int, k: int) -> DataFrame:
    """``anchor`` and whether it ``branches``, for the anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text", SLICE):
            found = Stretches(batch.column("_text"), window, k)
            columns = [pa.array(x.view(np.int64)) for x in (found.anchor, found.context)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context"])

    seen = keyed.select("_text").mapInArrow(run, "anchor bigint, context bigint")
    counted = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    return counted.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("branches"))


def _filter(repeated: DataFrame) -> np.ndarray:
    """Two bits for each hash value: a repeated edge that does not branch, and one that does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, np.uint8)
        for batch in batches:
            at = batch.column("anchor").to_numpy().view(np.uint64) % np.uint64(FILTER)
            branches = batch.column("branches").to_numpy(zero_copy_only=False)
            np.bitwise_or.at(bits, at, np.where(branches, 2, 1).astype(np.uint8))
        starts = [s for s in range(0, FILTER, _CHUNK) if bits[s : s + _CHUNK].any()]
        raw = [_packed(bits[s : s + _CHUNK]) for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["start", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(raw.as_buffer(), np.uint8) for raw in table.column("bits")])
        return pa.table({"start": table.column("start").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros(FILTER // 4, np.uint8)
    schema = "start bigint, bits binary"
    for row in repeated.mapInArrow(run, schema).groupBy("start").applyInArrow(merge, schema).collect():
        out[row["start"] // 4 : (row["start"] + _CHUNK) // 4] = np.frombuffer(row["bits"], np.uint8)
    return out


def _packed(bits: np.ndarray) -> bytes:
    four = bits.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def _passing(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = anchor % np.uint64(FILTER)
    return bits[(at >> np.uint64(2)).astype(np.int64)] >> ((at & np.uint64(3)) * np.uint64(2)).astype(np.uint8) & 3


def repeated_spans(keyed: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``_id``, ``_hash``, ``start``, ``stop``: stretches of words covered by repeated windows. ``keyed`` has ``_text`` as well."""
    found = written(edges(keyed, window, k), "edges")
    bits = keyed.sparkSession.sparkContext.broadcast(_filter(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches on paths that may not branch (``branches`` false), and windows of edges that may."""
        for batch in text_slices(batches, "_text", SLICE):
            own = Stretches(batch.column("_text"), window, k)
            kind = _passing(bits.value, own.anchor)
            one = np.flatnonzero(kind & 1)
            two = np.flatnonzero(kind & 2)
            of, at, first, second = own.windows(two) if len(two) else (two, two, own.anchor[two], own.anchor[two])
            text = np.concatenate((own.text[one], own.text[of]))
            ids = [pa.array(batch.column(n).to_numpy(zero_copy_only=False)[text], pa.int64()) for n in ("_id", "_hash")]
            none = np.zeros(len(one), np.uint64)
            columns = [
                pa.array(np.repeat([False, True], [len(one), len(of)])),
                pa.array(np.concatenate((own.anchor[one], own.anchor[of])).view(np.int64)),
                pa.array(np.concatenate((own.start[one], at))),
                pa.array(np.concatenate((own.end[one], at)) + window),
                pa.array(np.concatenate((none, first)).view(np.int64)),
                pa.array(np.concatenate((none, second)).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([*ids, *columns], names=[*"_id _hash branches anchor start stop first second".split()])

    schema = "_id bigint, _hash bigint, branches boolean, anchor bigint, start bigint, stop bigint, first bigint, second bigint"
    places = written(keyed.select("_id", "_hash", "_text").mapInArrow(run, schema), "edge-places")
    spans = ["_id", "_hash", "start", "stop"]
    paths = places.filter("not branches").join(found.filter("not branches").select("anchor"), "anchor").select(*spans)
    # A window's end follows from its start, so it is not shuffled.
    windows = places.filter("branches").select("_id", "_hash", "start", "first", "second")
    twice = windows.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = windows.join(twice, ["first", "second"]).select("_id", "_hash", "start", (F.col("start") + window).alias("stop"))
    return paths.union(repeated)


def deduped(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``row`` (all columns), ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by a space) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        text.alias("_text"),
    )
    spans = repeated_spans(keyed, window, k).groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    # The texts are shuffled once, within their rows.
    rows = keyed.select("row", "_id", "_hash").join(spans, ["_id", "_hash"], "left")
    words = F.regexp_extract_all(F.coalesce("row.text", F.lit("")), F.lit(WORD), F.lit(0))
    out = rows.select("row", "spans", F.inline(F.array(F.struct(words.alias("words")))))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.size("words").cast("bigint") - 1)
    left = F.when(F.col("spans").isNotNull(), F.transform(F.array_except(numbers, covered), lambda i: F.get("words", i.cast("int"))))
    out = out.select("row", "words", F.inline(F.array(F.struct(F.coalesce(left, F.col("words")).alias("left")))))
    n_words = F.size("words").cast("bigint")
    return out.select("row", n_words.alias("n_words"), (n_words - F.size("left")).alias("n_removed"), F.array_join("left", " ").alias("kept_text"))
