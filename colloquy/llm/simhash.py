"""SimHash near-duplicates, linked exactly with vantage-point trees.

A fingerprint has a bit for each bit that over half of a text's shingle hashes (XXH64 of three words joined by a
space, repeats included) set. Distinct fingerprints are dealt to shards by a vantage-point tree: a node sends
what lies within a radius of its pivot one way and the rest the other. A fingerprint also visits, as a probe, the
shards beyond every boundary that a link of at most ``MOST_BITS`` bits could cross; the triangle inequality rules
out the others. Within a shard the same tree goes on, and small leaves compare all, so links are exact. A shard
returns a spanning star for each group, not its pairs; components follow from those.

The pivots of the shard tree come from at most ``SAMPLE`` fingerprints, the least by a hash. This decides only where
fingerprints go. Copies of a text have one fingerprint and travel once, whatever their number.

Nulls: a null text has no words and fingerprint zero, as an empty one, and is linked like any other; a null
``doc_id`` is carried, and never names a component unless it has no other. Repeated rows are in one component. Long
texts are hashed in stretches. An empty table gives an empty table. Only ``doc_id`` and ``text`` are read, and
``keep_one`` carries all columns in a struct, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.graph import components
from colloquy.llm.store import written
from colloquy.llm.words import text_slices

SHINGLE = 3
SEED = 42
MOST_BITS = 2
SAMPLE = 16_384
#: Fingerprints a shard aims at, and those a leaf compares with each other.
SHARD = 20_000
LEAF = 128
_STRETCH = 200_000


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    set_bits = np.zeros(64, np.int64)
    for start in range(0, n, _STRETCH):
        some = words[start : min(n, start + _STRETCH) + SHINGLE - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(some, some[1:], some[2:])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the fingerprint's bits as a signed long) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints = np.array([fingerprint(text) for text in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"]
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


class Node(NamedTuple):
    """An inner node of the shard tree; a shard is a negative number, ``~shard``."""

    pivot: np.uint64
    radius: int
    near: int
    far: int


def _distance(prints: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ pivot).astype(np.int64)


def _radius(distances: np.ndarray, reach: int) -> int | None:
    """A radius near the median with few points just inside it; None if the points cannot be parted."""
    counts = np.bincount(distances, minlength=66)
    below = np.cumsum(counts)
    total = len(distances)
    good = [r for r in range(64) if 0.25 * total <= below[r] <= 0.75 * total]
    if not good:
        good = [r for r in range(64) if 0 < below[r] < total]
    if not good:
        return None
    return min(good, key=lambda r: (counts[max(0, r - reach + 1) : r + 1].sum(), abs(below[r] - total / 2)))


def shard_tree(sample: np.ndarray, shards: int, reach: int = MOST_BITS) -> list[Node]:
    """The inner nodes, the root first; empty for a single shard."""
    nodes: list[Node | None] = []
    made = 0

    def grow(points: np.ndarray, share: float) -> int:
        nonlocal made
        radius = None
        if share > 1 and len(points) > 4:
            pivot = points[len(points) // 2]
            distances = _distance(points, pivot)
            radius = _radius(distances, reach)
        if radius is None:
            made += 1
            return ~(made - 1)
        at = len(nodes)
        nodes.append(None)
        near = distances <= radius
        part = near.mean()
        first, second = grow(points[near], share * part), grow(points[~near], share * (1 - part))
        nodes[at] = Node(pivot, radius, first, second)
        return at

    grow(sample, float(shards))
    return nodes


def route(prints: np.ndarray, nodes: list[Node], reach: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each visit: the index of the fingerprint, its shard, and whether it is at home there."""
    index = np.arange(len(prints))
    if not nodes:
        return index, np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
    out, stack = [], [(0, index, np.ones(len(prints), bool))]
    while stack:
        at, who, home = stack.pop()
        if not len(who):
            continue
        if at < 0:
            out.append((who, np.full(len(who), ~at), home))
            continue
        node = nodes[at]
        d = _distance(prints[who], node.pivot)
        inside = d <= node.radius
        # A point inside seeks partners outside as a probe; points outside need not seek those inside.
        near = np.where(home, inside, d - reach <= node.radius)
        far = np.where(home, ~inside, d + reach > node.radius)
        seek = home & inside & (d + reach > node.radius)
        stack.append((node.near, who[near], home[near]))
        stack.append((node.far, np.concatenate((who[far], who[seek])), np.concatenate((home[far], np.zeros(seek.sum(), bool)))))
    return tuple(np.concatenate(part) for part in zip(*out))


def links(home: np.ndarray, probes: np.ndarray, reach: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into ``home`` followed by ``probes`` at most ``reach`` bits apart, at least one of them at home."""
    prints = np.concatenate((home, probes))
    left, right = [], []
    stack = [(np.arange(len(home)), np.arange(len(home), len(prints)))]
    while stack:
        own, seek = stack.pop()
        if not len(own):
            continue
        split = None
        if len(own) > LEAF:
            pivot = prints[own[len(own) // 2]]
            d, e = _distance(prints[own], pivot), _distance(prints[seek], pivot)
            split = _radius(d, reach)
        if split is None:
            every = np.concatenate((own, seek))
            for start in range(0, len(own), LEAF):
                some = own[start : start + LEAF]
                a, b = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[every][None, :]) <= reach)
                a, b, probe = some[a], every[b], b >= len(own)
                # Two at home meet twice, once from either side; a probe meets each of them once, whatever its number.
                real = (a < b) | probe
                left.append(a[real])
                right.append(b[real])
            continue
        inside = d <= split
        stack.append((own[inside], seek[e - reach <= split]))
        stack.append((own[~inside], np.concatenate((seek[e + reach > split], own[inside & (d + reach > split)]))))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def stars(home: np.ndarray, probes: np.ndarray, reach: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each group of linked fingerprints of a shard: members and their centre."""
    prints = np.concatenate((home, probes))
    a, b = links(home, probes, reach)
    label = np.arange(len(prints))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(prints)))
    return prints[member], prints[label[member]]


def linked(prints: DataFrame, reach: int = MOST_BITS, shard: int = SHARD) -> DataFrame:
    """``u``, ``v``: links that span the groups of the distinct values in ``fp``."""
    count = prints.count()
    shards = max(1, -(-count // shard))
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if shards > 1 else []
    nodes = shard_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), shards, reach)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if len(own):
                who, where, home = route(own, nodes, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), pa.array(own[who].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"]
                )

    def join(table: pa.Table) -> pa.Table:
        own = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        u, v = stars(np.sort(own[home]), np.sort(own[~home]), reach)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = prints.select("fp").mapInArrow(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(join, "u bigint, v bigint")


def _rooted(docs: DataFrame, reach: int) -> DataFrame:
    """``grouped`` with ``root``, the fingerprint that stands for the component, which always names just one."""
    rows = written(fingerprints(docs), "simhash-prints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = written(classes, "simhash-classes")
    found = components(linked(classes, reach)).withColumnRenamed("node", "fp")
    rooted = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(named, "root"), "fp")


def grouped(docs: DataFrame, reach: int = MOST_BITS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` and ``component_id``, the least ``doc_id`` reachable over links."""
    return _rooted(docs, reach).drop("root")


def keep_one(docs: DataFrame, reach: int = MOST_BITS) -> DataFrame:
    """One document of each component, the one of the least ``doc_id``, with all its columns."""
    # Components may share a ``component_id``: a null one, or an id with unlike texts.
    found = _rooted(docs, reach)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    keep = first.select(F.col("k.n").alias("_n"), F.coalesce("k.doc_id", F.lit(0)).alias("_id"), F.col("k.text_hash").alias("_hash"))
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").isNull().alias("_n"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash"),
    )
    return keyed.join(keep, ["_n", "_id", "_hash"]).dropDuplicates(["_n", "_id", "_hash"]).select("row.*")
