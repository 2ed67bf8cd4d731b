"""Near-duplicate lines by an exact set-similarity join.

A line is what lies between line feeds; its set are its distinct words, compared as they are. A line goes if an
earlier line, by (``doc_id``, hash of the text, line number), has a Jaccard similarity of 0.8 or more, be it in the same
text or another. Lines without words stay. The rule looks at the input only, so removals do not depend on each other.

Words are ordered by rarity: by a table of ``BUCKETS`` counters over all texts, then by their hash. Only the rarest words
of a line, which a similar line must share, are posted, as packed records in a blob for each batch and bucket of
words. A bucket's postings are sorted by word and length; pairs are formed within a word and the lengths that can be
similar, and pass the positional filter and a filter on 64, 128 or 256 parities of the sets, both of which lose no similar
pair. Larger sets have more parities: unlike sets fill too few so evenly that they would seem similar.
A line needs one earlier line only: for each word it first names one candidate, the earliest that passes, so a group
of near copies makes as many pairs as lines. Candidates are verified on their words. Lines whose candidates all failed
are joined again, with all candidates of the words that named one; the postings that they may meet are stored for it by the first join, so texts
are not cut into words again. Equal sets (told by 128 bits) are one class from the start, so
copies form no pairs: a batch sends the first line of each of its sets to the set's part; the others are copies at
once, and go to parts by their place, however often a line occurs. A word that more than ``HOT`` lines hold is dealt to cells, two parts of its lines each.

Nulls: a null text has no lines and stays null; a null ``doc_id`` comes last. Different texts that share an id, null ones
too, are ordered by their hash. Repeated rows (same id and text) are one
document and get the same result. Empty tables give empty tables. All columns travel in a struct, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.store import written
from colloquy.llm.words import SPACES, Words, chunk_lanes, split, text_slices  # noqa: F401 (tests take chunk_lanes from here)

BUCKETS = 1 << 20
HOT = 1 << 16
#: Bytes of text whose postings one task joins.
PART_BYTES = 4 << 20
SLICE = 3 << 20
#: Sets up to ``FOLDED`` words have 64 parities, those up to ``WIDE`` have 128, larger ones 256.
FOLDED, WIDE = 64, 192
PARITIES = ("p0", "p1", "p2", "p3")
#: Bits of the filters that tell which sets or words a further pass needs; they may let through more.
BITS = 1 << 24
_CHUNK = 1 << 14
_PAIRS = 1 << 21

#: A word that is posted: its key, the set's hash, parities, first line in the batch and size, and the word's place in the set.
#: ``tie`` is the hash of the text where different texts may share the id, else zero.
POSTING = np.dtype(
    [("key", "<u4"), ("set", "<u8"), *((p, "<u8") for p in PARITIES), ("id", "<i8"), ("tie", "<i8"), ("line", "<i4"), ("size", "<i4"), ("place", "<i4")]
)
#: A line: both hashes of its set, and where it is.
LINE = np.dtype([("set", "<u8"), ("other", "<u8"), ("id", "<i8"), ("hash", "<i8"), ("line", "<i4")])
#: A line that goes because an earlier one of its batch has the same set.
COPY = np.dtype([("id", "<i8"), ("hash", "<i8"), ("line", "<i4")])


def packed(columns: list[np.ndarray]) -> bytes:
    """Records column by column, which compresses better than row by row; each without the zeros that it begins with."""
    zeros = []
    for column in columns:
        begin = 0 if column[0] else int(np.argmax(column != 0))
        zeros.append(begin if column[begin] else len(column))
    head = np.array([len(columns[0]), *zeros], "<i4")
    return b"".join((head, *(c[z:] for c, z in zip(columns, zeros))))


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    heads = [np.frombuffer(raw, "<i4", 1 + len(kind.names)).tolist() for raw in blobs]
    out = np.zeros(sum(n for n, *_ in heads), kind)
    fields, at = [(out[name], kind[name]) for name in kind.names], 0
    for raw, (n, *zeros) in zip(blobs, heads):
        offset = 4 * (1 + len(zeros))
        for (field, own), begin in zip(fields, zeros):
            if begin < n:
                field[at + begin : at + n] = np.frombuffer(raw, own, n - begin, offset)
                offset += (n - begin) * own.itemsize
        at += n
    return out


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    """Another 64-bit hash of hashes."""
    x = x * np.uint64(by | 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_table(docs: DataFrame) -> np.ndarray:
    """Counters of all words of all texts, by hash; a fixed size whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for batch in text_slices(batches, limit=SLICE // 4):
            np.add.at(table, (Words(batch.column("text")).hashes() % np.uint64(BUCKETS)).astype(np.int64), 1)
        starts = list(range(0, BUCKETS, _CHUNK))
        parts = [np.minimum(table[s : s + _CHUNK], 2**31 - 1).astype("<i4").tobytes() for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], names=["start", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw.as_buffer(), "<i4").astype(np.int64) for raw in table.column("counts"))
        return pa.table({"start": table.column("start").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "start bigint, counts binary"
    table = np.zeros(BUCKETS, np.int64)
    for row in docs.select("text").mapInArrow(count, schema).groupBy("start").applyInArrow(add, schema).collect():
        table[row["start"] : row["start"] + _CHUNK] = np.frombuffer(row["counts"], np.int64)
    return table


def similar_at_least(a, b):
    """Words two sets of these sizes must share for a Jaccard similarity of 0.8."""
    return (4 * (a + b) + 8) // 9


def by_rarity(counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The order of words by count, then by their hashes; most are told apart by one number of 24 and 40 bits."""
    counts = np.minimum(counts, (1 << 24) - 1).astype(np.uint64)
    both = (counts << np.uint64(40)) | (one >> np.uint64(24))
    order = np.argsort(both)
    if (both[order][1:] == both[order][:-1]).any():
        order = np.lexsort((two, one, counts))
    return order


def folded(parities: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """Parities of sets, or of what two sets differ in, as those of sets of these sizes; unused ones are zero."""
    p0, p1, p2, p3 = parities
    zero, wide, small = np.uint64(0), sizes > WIDE, sizes <= FOLDED
    p0, p1, p2, p3 = np.where(wide, p0, p0 ^ p2), np.where(wide, p1, p1 ^ p3), np.where(wide, p2, zero), np.where(wide, p3, zero)
    return [np.where(small, p0 ^ p1, p0), np.where(small, zero, p1), p2, p3]


def may_post(offsets: np.ndarray, codes: np.ndarray, wanted: np.ndarray, common: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Lines that may post a wanted word or a common one; ``wanted``, ``common`` and ``mark`` (one bit) are those of each word.

    A line posts a common word only if at most a fifth of its distinct words are others, of which there are as many as marks at least.
    """
    own = np.flatnonzero(np.diff(offsets))
    starts, usual, found = offsets[:-1][own], common[codes], np.zeros(len(offsets) - 1, bool)
    if len(own):
        others = np.bitwise_count(np.bitwise_or.reduceat(np.where(usual, np.uint64(0), mark[codes]), starts)).astype(np.int64)
        some = usual.any() and (np.add.reduceat(usual.astype(np.int64), starts) >= np.maximum(4 * others, 1))
        found[own] = np.logical_or.reduceat((wanted & ~common)[codes], starts) | some
    return found


def line_sets(texts: pa.Array, table: np.ndarray, ids: np.ndarray, ties: np.ndarray, wanted: np.ndarray | None = None, part_of: Callable | None = None):
    """Lines with words of a batch: index of text, line number, set hashes, and the postings of their sets.

    With a filter of ``wanted`` words, lines that post none of them may be left out. With ``part_of`` keys, postings come in the order of parts.
    """
    found = Words(texts)
    starts, offsets = found.heads, found.offsets
    codes, word_hash, word_other = found.coded()
    counts = table[word_hash % np.uint64(BUCKETS)]
    by_rank = by_rarity(counts, word_hash, word_other)
    rank = np.empty(len(by_rank), np.int64)
    rank[by_rank] = np.arange(len(by_rank))
    of_line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bit = _mix(word_hash, 0x165667B19E3779F9)
    flag = np.uint64(1) << (bit & np.uint64(63))
    if wanted is not None:
        some = may_post(offsets, codes, _in(wanted, word_hash >> np.uint64(32)), counts > HOT, flag)[of_line]
        of_line, codes = of_line[some], codes[some]
    bits = len(by_rank).bit_length()
    keys = np.sort((of_line << bits) | rank[codes])
    keys = keys[np.diff(keys, prepend=-1) > 0]
    if not len(keys):
        return None
    of_line, own = keys >> bits, by_rank[keys & ((1 << bits) - 1)]
    first = np.flatnonzero(np.diff(of_line, prepend=-1))
    real, sizes = of_line[first], np.diff(first, append=len(of_line))
    one = np.add.reduceat(_mix(word_hash, 0x9E3779B97F4A7C15)[own], first)
    two = np.add.reduceat(_mix(word_other, 0xC2B2AE3D27D4EB4F)[own], first)
    quarter = (bit >> np.uint64(6)) & np.uint64(3)
    parities = [np.bitwise_xor.reduceat(np.where(quarter == np.uint64(k), flag, np.uint64(0))[own], first) for k in range(4)]
    text = np.searchsorted(starts, real, side="right") - 1
    number = real - starts[text]
    # A batch posts each of its sets once. Sets of fewer than four words are similar to equal ones only.
    order = np.lexsort((number, ties[text], ids[text], two, one))
    once = np.zeros(len(real), bool)
    once[order[_changes(one[order], two[order])]] = True
    posted = np.where(once & (sizes >= 4), sizes - (4 * sizes + 4) // 5 + 1, 0)
    which = np.repeat(np.arange(len(real)), posted)
    place = np.arange(len(which)) - np.repeat(np.cumsum(posted) - posted, posted)
    post = own[first[which] + place]
    key, again = _celled((word_hash[post] >> np.uint64(32)).astype(np.uint32), one[which], counts[post])
    which, place = which[again], place[again]
    if part_of:
        order = _by_part(part_of(key), sizes[which])
        key, which, place = key[order], which[order], place[order]
    posting = np.empty(len(key), POSTING)
    for name, values in (("set", one), *zip(PARITIES, folded(parities, sizes)), ("size", sizes), ("id", ids[text]), ("tie", ties[text]), ("line", number)):
        posting[name] = values[which]
    posting["key"], posting["place"] = key, place
    return text, number, one, two, posting


def _celled(key: np.ndarray, own_set: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of very common words go to the cells of their part with every part: the keys, and the posting of each."""
    hot, rest = np.flatnonzero(counts > HOT), np.flatnonzero(counts <= HOT)
    if not len(hot):
        return key, rest
    parts = -(-counts[hot] // HOT)
    again = np.repeat(hot, parts)
    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (own_set[again] % np.repeat(parts, parts).astype(np.uint64)).astype(np.int64)
    cell = np.minimum(own, other) * 65_537 + np.maximum(own, other) + 1
    dealt = _mix(key[again].astype(np.uint64) + (cell.astype(np.uint64) << np.uint64(32)), 0x27D4EB2F165667C5)
    return np.concatenate((key[rest], (dealt >> np.uint64(32)).astype(np.uint32))), np.concatenate((rest, again))


def _by_part(part: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of postings by part, small sets first: their records begin with zeros for the parities that they do not have."""
    by = 3 * part + (sizes > FOLDED) + (sizes > WIDE)
    return np.argsort(by.astype(np.uint16) if len(by) and by.max() < 1 << 16 else by, kind="stable")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first one does."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def firsts(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines by set and place, each place once, and whether each is the first of its set."""
    line = line[np.lexsort((line["line"], line["hash"], line["id"], line["other"], line["set"]))]
    line = line[np.concatenate(([True], line[1:] != line[:-1]))]
    first = np.ones(len(line), bool)
    first[1:] = (line["set"][1:] != line["set"][:-1]) | (line["other"][1:] != line["other"][:-1])
    return line, first


def _by_word(posting: np.ndarray) -> np.ndarray:
    """The order of postings by word, then place of the line."""
    key, ids, line = posting["key"], posting["id"], posting["line"].astype(np.int64)
    if not len(posting):
        return np.empty(0, np.int64)
    least, lines = int(ids.min()), int(line.max()) + 1
    places = (int(ids.max()) - least + 1) * lines
    if posting["tie"].any() or places > 1 << 62:
        return np.lexsort((line, posting["tie"], ids, key))
    place = (ids - least) * lines + line
    if places > 1 << 32:
        return np.lexsort((place, key))
    return np.argsort((key.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64), kind="stable")


def candidates(posting: np.ndarray, every: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (set, candidate) that share a posted word and pass the length, positional and parity filters, and the words.

    The candidate's first line is the earlier one. Each set and word has the earliest candidate only; sets in
    the filter ``every`` have all, and others none, if it is given.
    """
    posting, pairs = _candidates(posting, every)
    return np.stack((posting["set"][pairs[:, 0]], posting["set"][pairs[:, 1]]), axis=1), posting["key"][pairs[:, 0]]


def _candidates(posting: np.ndarray, every: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The postings of words that have several, by word and place, and the pairs as their numbers, later one first."""
    # A word of one posting makes no pairs.
    order = np.argsort(posting["key"])
    again = np.flatnonzero(~_changes(posting["key"][order]))
    alone = np.ones(len(order), bool)
    alone[again] = alone[again - 1] = False
    posting = posting[order[~alone]]
    # Earlier lines first within a word; ``start`` is the first posting of the word.
    posting = posting[_by_word(posting)]
    # The first of a set's postings with a word is the earliest.
    both = _mix(posting["set"] + posting["key"] * np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F)
    order = np.argsort(both)
    new = np.flatnonzero(_changes(posting["key"][order], posting["set"][order]))
    posting = posting[np.sort(np.minimum.reduceat(order, new))] if len(new) else posting
    key, size, place = posting["key"], posting["size"].astype(np.int64), posting["place"].astype(np.int64)
    parities = [posting[p].copy() for p in PARITIES]
    n = len(posting)
    start = np.searchsorted(key, key, side="left") if n else np.empty(0, np.int64)
    open_ = np.flatnonzero(np.arange(n) > start)
    if every is not None:
        open_ = open_[_in(every, posting["set"][open_])]
    reach, found = start[open_], [np.empty((0, 2), np.int64)]
    # Each turn tries the next few earlier lines of all words that have some left; few words have many lines.
    width = 8
    while len(open_):
        some = np.minimum(open_ - reach, width)
        for low_, high_ in _cuts(some):
            o, w = open_[low_:high_], some[low_:high_]
            a = np.repeat(o, w)
            b = np.repeat(reach[low_:high_], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            good = 5 * small >= 4 * large
            a, b = a[good], b[good]
            need = similar_at_least(size[a], size[b])
            good = np.minimum(size[a] - place[a], size[b] - place[b]) >= need
            a, b, need = a[good], b[good], need[good]
            # A pair has as many parities as its smaller set.
            differ = folded([p[a] ^ p[b] for p in parities], np.minimum(size[a], size[b]))
            apart = sum(np.bitwise_count(x).astype(np.int64) for x in differ)
            good = apart <= size[a] + size[b] - 2 * need
            found.append(np.stack((a[good], b[good]), axis=1))
        reach = reach + some
        going = reach < open_
        if every is None:
            settled = np.zeros(n, bool)
            settled[found[-1][:, 0]] = True
            for part in found[:-1]:
                settled[part[:, 0]] = True
            going &= ~settled[open_]
        open_, reach = open_[going], reach[going]
        width = min(width * 4, 1 << 14)
    pairs = np.concatenate(found)
    if every is None:
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.diff(pairs[:, 0], prepend=-1) != 0]
    return posting, pairs


def _met(posting: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of ``_candidates``, the postings that may be in further pairs of the sets that named one by the same word: none is later than the last of
    these, nor of a length that is similar to none."""
    key, size = posting["key"], posting["size"].astype(np.int64)
    own = np.sort(pairs[:, 0])
    first = np.flatnonzero(_changes(key[own]))
    words, last = key[own[first]], own[np.append(first[1:], len(own)) - 1]
    least, most = np.minimum.reduceat(size[own], first), np.maximum.reduceat(size[own], first)
    word = np.minimum(np.searchsorted(words, key), len(words) - 1)
    some = (words[word] == key) & (np.arange(len(key)) <= last[word]) & (5 * size >= 4 * least[word]) & (4 * size <= 5 * most[word])
    some = np.flatnonzero(some)
    return posting[some[np.argsort(size[some], kind="stable")]]


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes sum to about ``_PAIRS``."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, side="right")))
        yield start, stop
        start = stop


def _in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.uint64) % np.uint64(BITS)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def place_keys(ids: np.ndarray, text_hash: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of a line's place: id and hash of its text, and its number."""
    own = _mix(ids.astype(np.int64).view(np.uint64), 0x9E3779B97F4A7C15) ^ text_hash.astype(np.int64).view(np.uint64)
    return _mix(own + number.astype(np.uint64), 0xC2B2AE3D27D4EB4F)


def bit_filter(rows: DataFrame, *columns: str) -> np.ndarray:
    """A bit for each hash value in a column of longs, or for each place in three; a fixed size whatever the number of rows."""
    step = _CHUNK * 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, np.uint8)
        for batch in batches:
            values = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            values = place_keys(*values) if len(values) > 1 else values[0].view(np.uint64)
            bits[(values % np.uint64(BITS)).astype(np.int64)] = 1
        starts = [s for s in range(0, BITS, step) if bits[s : s + step].any()]
        raw = [np.packbits(bits[s : s + step], bitorder="little").tobytes() for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["start", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(raw.as_buffer(), np.uint8) for raw in table.column("bits")])
        return pa.table({"start": table.column("start").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    out, schema = np.zeros(BITS // 8, np.uint8), "start bigint, bits binary"
    seen = rows.select(*columns).mapInArrow(run, schema).groupBy("start").applyInArrow(merge, schema)
    for row in seen.collect():
        out[row["start"] // 8 : (row["start"] + step) // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )


class Join:
    """The passes over the texts; ``keyed`` is ``_keyed`` of the documents."""

    def __init__(self, keyed: DataFrame):
        self.rows = keyed.select("_id", "_hash", "_text")
        ids = self.rows.groupBy("_id").agg(
            F.min("_hash").alias("least"), F.max("_hash").alias("most"), F.sum(F.octet_length("_text")).alias("bytes")
        )
        ids = written(ids, "line-ids")
        size = ids.agg(F.sum("bytes").alias("b")).first()["b"] or 0
        self.parts = max(1, size // PART_BYTES)
        self.share = keyed.sparkSession.sparkContext.broadcast
        self.shared = self.share(bit_filter(ids.filter("least < most"), "_id"))
        self.table = self.share(word_table(self.rows.select(F.col("_text").alias("text"))))

    def lines_and_pairs(self) -> DataFrame:
        """Lines (``kind`` 1: both set hashes in ``x``, ``y``, which some copies lack, place, and whether first of their set), pairs (``kind`` 0: set,
        candidate, and the word in ``id``), and the postings of a part that those sets may meet by those words (``kind`` 2, ``blob``)."""
        return self._joined()

    def all_pairs(self, found: DataFrame, sets: np.ndarray, words: np.ndarray) -> DataFrame:
        """All candidates of the sets in a filter, by the words in another, of those that have named one in ``found``."""
        sets, words = self.share(sets), self.share(words)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob"):
                    posting = unpacked([blob.as_buffer()], POSTING)
                    posting = posting[_in(words.value, posting["key"].astype(np.uint64))]
                    pair = np.unique(candidates(posting, sets.value)[0].view(np.int64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k])) for k in range(2)], names=["x", "y"])

        return found.filter("kind = 2").select("blob").mapInArrow(join, "x bigint, y bigint")

    def dealt(self) -> DataFrame:
        """Blobs by ``kind`` and ``part``: postings (0), the first line of each set of a batch (1), and copies of those (2)."""
        parts, table, shared = self.parts, self.table, self.shared

        def part_of(key: np.ndarray) -> np.ndarray:
            return (_mix(key.astype(np.uint64), 0x85EBCA77C2B2AE63) % np.uint64(parts)).astype(np.int64)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, "_text", SLICE):
                ids, text_hash = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_id", "_hash"))
                ties = np.where(_in(shared.value, ids), text_hash, 0)
                if (found := line_sets(batch.column("_text"), table.value, ids, ties, None, part_of)) is None:
                    continue
                text, number, one, two, posting = found
                line = np.empty(len(text), LINE)
                line["set"], line["other"], line["line"], line["id"], line["hash"] = one, two, number, ids[text], text_hash[text]
                yield _blobs(0, posting, part_of(posting["key"]))
                line, first = firsts(line)
                copy, line = line[~first], line[first]
                place = place_keys(copy["id"], copy["hash"], copy["line"].astype(np.int64))
                yield _blobs(1, line, (line["set"] % np.uint64(parts)).astype(np.int64))
                yield _blobs(2, copy[list(COPY.names)].astype(COPY), (place % np.uint64(parts)).astype(np.int64))

        return self.rows.mapInArrow(post, "kind int, part bigint, blob binary")

    def _joined(self) -> DataFrame:
        def join(table: pa.Table) -> pa.Table:
            raw = [blob.as_buffer() for blob in table.column("blob")]
            kind = table.column("kind")[0].as_py()
            if kind == 0:
                posting, pairs = _candidates(unpacked(raw, POSTING))
                x, y = (posting["set"][pairs[:, k]].view(np.int64) for k in range(2))
                word, none = pa.array(posting["key"][pairs[:, 0]].astype(np.int64)), pa.nulls(len(x), pa.int64())
                out = _as_rows(0, x, y, word, none, none, pa.nulls(len(x), pa.bool_()))
                if not len(x):
                    return out
                named = _met(posting, pairs)
                blob = pa.array([packed([np.ascontiguousarray(named[n]) for n in named.dtype.names])], pa.binary())
                none, no = pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_())
                return pa.concat_tables([out, _as_rows(2, none, none, none, none, none, no, blob)])
            if kind == 2:
                copy = unpacked(raw, COPY)
                places, none = [pa.array(copy[n].astype(np.int64)) for n in COPY.names], pa.nulls(len(copy), pa.int64())
                return _as_rows(1, none, none, *places, pa.array(np.zeros(len(copy), bool)))
            line, first = firsts(unpacked(raw, LINE))
            places = [pa.array(line[n].astype(np.int64)) for n in COPY.names]
            return _as_rows(1, line["set"].view(np.int64), line["other"].view(np.int64), *places, pa.array(first))

        schema = "kind int, x bigint, y bigint, id bigint, hash bigint, line bigint, first boolean, blob binary"
        return self.dealt().groupBy("kind", "part").applyInArrow(join, schema)

    def lines(self, places: np.ndarray) -> DataFrame:
        """``id``, ``hash``, ``line``, ``words`` (distinct, joined by spaces) and their number ``size`` of the lines whose place
        is in a filter; the texts are cut into lines only."""
        bits = self.share(places)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, "_text", SLICE):
                cut = pc.split_pattern(batch.column("_text"), "\n")
                starts = cut.offsets.to_numpy().astype(np.int64)
                text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                number = np.arange(len(text)) - (starts[:-1] - starts[0])[text]
                ids, text_hash = (batch.column(n).to_numpy(zero_copy_only=False)[text] for n in ("_id", "_hash"))
                some = np.flatnonzero(_in(bits.value, place_keys(ids, text_hash, number)))
                columns = [pa.array(x[some], pa.int64()) for x in (ids, text_hash, number)]
                words, size = _sets_of(cut.flatten().take(pa.array(some)))
                yield pa.RecordBatch.from_arrays([*columns, words, pa.array(size)], names=["id", "hash", "line", "words", "size"])

        schema = "id bigint, hash bigint, line bigint, words string, size bigint"
        return self.rows.mapInArrow(run, schema).dropDuplicates(["id", "hash", "line"])


def _blobs(kind: int, records: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    if (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        records, part = records[order], part[order]
    columns = [np.ascontiguousarray(records[name]) for name in records.dtype.names]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    raw = [packed([c[low:high] for c in columns]) for low, high in zip(cuts, [*cuts[1:], len(part)])]
    columns = [pa.array([kind] * len(raw), pa.int32()), pa.array(part[cuts], pa.int64()), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "blob"])


def _as_rows(kind: int, x: np.ndarray | pa.Array, y: np.ndarray | pa.Array, id_, hash_, line, first, blob: pa.Array | None = None) -> pa.Table:
    x, y = (pa.array(np.ascontiguousarray(v)) if isinstance(v, np.ndarray) else v for v in (x, y))
    columns = [pa.array(np.full(len(x), kind, np.int32)), x, y, id_, hash_, line, first, pa.nulls(len(x), pa.binary()) if blob is None else blob]
    return pa.table(dict(zip(("kind", "x", "y", "id", "hash", "line", "first", "blob"), columns)))


def _sets_of(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of each line in one string, and their number."""
    offsets, codes, words = split(lines)
    of_line = np.repeat(np.arange(len(lines)), np.diff(offsets))
    of_line, own = np.divmod(np.unique(of_line * max(1, len(words)) + codes), max(1, len(words)))
    size = np.bincount(of_line, minlength=len(lines))
    sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), words.take(pa.array(own)))
    return pc.binary_join(sets, " "), size


def _verified(pairs: DataFrame, heads: DataFrame, join: Join) -> DataFrame:
    """``x`` and first place ``p`` of the sets in ``pairs`` that are similar to an earlier one of their candidates."""
    ends = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    needed = written(heads.join(ends, "set").select("set", "at", "at.*"), "line-heads")
    lines = join.lines(bit_filter(needed, "id", "hash", "line"))
    known = written(needed.join(lines, ["id", "hash", "line"]).select("set", "at", "words", "size"), "line-words")
    left = known.select(F.col("set").alias("x"), F.col("at").alias("p"), F.col("words").alias("v"), F.col("size").alias("m"))
    right = known.select(F.col("set").alias("y"), F.col("at").alias("q"), F.col("words").alias("w"), F.col("size").alias("n"))
    same = F.size(F.array_intersect(F.split("v", " "), F.split("w", " ")))
    near = pairs.join(left, "x").join(right, "y").filter((F.col("q") < F.col("p")) & (9 * same >= 4 * (F.col("m") + F.col("n"))))
    return near.select("x", "p").distinct()


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """``_id``, ``_hash``, ``line`` of every line that goes. ``keyed`` is ``_keyed`` of the documents."""
    join = Join(keyed)
    found = written(join.lines_and_pairs(), "line-pairs")
    copies = found.filter("kind = 1 and not first").select("id", "hash", "line")
    heads = found.filter("kind = 1 and first").select(F.col("x").alias("set"), F.col("y").alias("other"), F.struct("id", "hash", "line").alias("at"))
    named = found.filter("kind = 0").select("x", "y", F.col("id").alias("word"))
    gone = written(_verified(named.select("x", "y").distinct(), heads, join), "line-gone")
    # Two sets of one hash share ``x``: both stay open unless both are gone, and a verdict twice does no harm.
    open_ = written(named.join(gone, "x", "left_anti").select("x", "word").distinct(), "line-open")
    sets, words = bit_filter(open_, "x"), bit_filter(open_, "word")
    more = join.all_pairs(found, sets, words).distinct().join(named.select("x", "y"), ["x", "y"], "left_anti")
    later = gone.union(_verified(written(more, "line-more"), heads, join)).select("p.id", "p.hash", "p.line")
    gone = copies.union(later).distinct()
    return gone.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("line").cast("int").alias("line"))


def deduped(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``n_lines``, ``n_removed`` and ``kept_text`` of each document."""
    keyed = _keyed(docs)
    gone = repeated_lines(keyed).groupBy("_id", "_hash").agg(F.collect_list("line").alias("gone"))
    gone = written(gone, "line-lists")
    # Texts are shuffled once, within their rows, and only those that a filter takes for cut ones; it has ``BITS`` / 64 rows at most.
    slot = F.pmod(F.xxhash64("_id", "_hash"), F.lit(BITS))
    marks = gone.select(slot.alias("slot")).selectExpr("slot div 64 as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = keyed.select("row", "_id", "_hash", slot.alias("slot")).withColumn("word", F.expr("slot div 64"))
    rows = rows.join(F.broadcast(marks), "word", "left")
    cut = F.coalesce(F.expr("shiftright(bits, cast(slot % 64 as int)) & 1"), F.lit(0)) == 1
    joined = rows.filter(cut).join(gone, ["_id", "_hash"], "left").select("row", "gone")
    text = F.col("row.text")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    out = joined.select("row", "gone", F.inline(F.array(F.struct(lines.alias("lines")))))
    out = out.withColumn("n_lines", F.size("lines").cast("bigint"))
    numbers = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("gone"))
    kept = F.transform(numbers, lambda i: F.get(F.col("lines"), i))
    removed = F.coalesce(F.size("gone"), F.lit(0))
    some = out.select(
        "row",
        F.when(text.isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(removed).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    whole = rows.filter(~cut).select("row", F.coalesce(feeds + 1, F.lit(0)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"), text.alias("kept_text"))
    return some.union(whole)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their remaining lines; one that lost all its words goes. ``n_chars``, if there, is counted anew."""
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = deduped(docs).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(f"[^{SPACES}]"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return out.select(*[(F.col(f"row.`{c}`") if c in columns else new[c]).alias(c) for c in docs.columns])
