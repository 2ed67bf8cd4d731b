"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest distance.
Centroids come from k-means over at most ``SAMPLE`` vectors, the least by a hash of their id; every
vector is indexed. A vector joins the list of its nearest centroid and of up to ``COPIES - 1`` more whose distance is
within ``REPLICA_RATIO`` of it, so boundary vectors are in several lists. Centroids are found by a graph that
each task holds in memory: a beam search over their nearest neighbours, at every number of lists. A query reads the lists whose
centroid is within ``SEARCH_RATIO`` of its nearest one, however many they are (the beam widens until it has passed that
ratio), and at least ``LEAST_LISTS``; those are read first, and of the others only what reaches the score they give is passed on. Lists are cut into pieces of about
``PIECE`` vectors, dealt by a hash, and so are the queries of a list; each piece returns its best for each query, and the
best of all pieces follow.
Scores are recomputed on the original vectors in double precision, row by row, so equal vectors tie exactly.

Bounds: centroids number one per ``LIST`` vectors, at most ``MOST_LISTS``; lists grow beyond that, pieces do not.

Nulls: vectors that are null, empty, all zero, of another length than the most common one, or hold null or non-finite
components take no part, as query or candidate; so do rows with a null id. Repeated rows (an id twice) are each a
candidate once by id; with different vectors under one id, the better score counts. An empty table gives
an empty table. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.store import written

SAMPLE = 65_536
LIST = 128
MOST_LISTS = 16_384
PIECE = 4_096
COPIES = 4
REPLICA_RATIO = 1.15
SEARCH_RATIO = 1.15
LEAST_LISTS = 32
NEIGHBOURS = 16
ROUNDS = 8
SEED = 7
#: Doubles of a matrix that a search or a fit makes at once, and beam members that a search expands in a round.
_BLOCK = 1 << 22
_EXPAND = 8


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(vector, lambda x: x != 0)
    good = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite & nonzero)
    good = good.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("v") == (size["n"] if size else 0))


def _lists(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


class Centroids:
    """Centroids, and a graph over them that finds the nearest ones."""

    def __init__(self, sample: np.ndarray, count: int, largest: float):
        self.largest = largest
        points = self.lifted(sample)
        rng = np.random.default_rng(SEED)
        rows = 1
        centres = points[rng.permutation(len(points))[: max(1, min(count, len(points)))]].copy()
        for _ in range(ROUNDS):
            rows = max(1, _BLOCK // len(centres))
            own = np.concatenate([_squared(points[i : i + rows], centres).argmin(1) for i in range(0, len(points), rows)])
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            sizes = np.bincount(own, minlength=len(centres))
            filled = sizes > 0
            centres[filled] = sums[filled] / sizes[filled, None]
            # An empty list takes a point of the fullest lists: lists stay balanced.
            spare = np.argsort(-sizes[own], kind="stable")[: (~filled).sum()]
            centres[~filled] = points[spare][: (~filled).sum()]
        self.centres = centres
        near = min(NEIGHBOURS, len(centres))
        blocks = [_squared(centres[i : i + rows], centres).argsort(1)[:, :near] for i in range(0, len(centres), rows)]
        forth = np.concatenate(blocks)
        # Links lead back as well, from the nearest ones first; a few random ones keep the graph connected.
        source, target = np.repeat(np.arange(len(centres)), near), forth.ravel()
        order = np.lexsort((np.tile(np.arange(near), len(centres)), target))
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        back = np.tile(np.arange(len(centres))[:, None], NEIGHBOURS)
        fits = place < NEIGHBOURS
        back[target[fits], place[fits]] = source[fits]
        links = rng.integers(0, len(centres), (len(centres), 8))
        self.graph = np.concatenate((forth, back, links), axis=1)
        self.entry = rng.permutation(len(centres))[: min(64, len(centres))]

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """With one more component; a query is scaled to the common norm and gets a zero."""
        norms = (vectors * vectors).sum(1)
        if query:
            scale = self.largest / np.sqrt(norms)
            return np.concatenate((vectors * scale[:, None], np.zeros((len(vectors), 1))), axis=1)
        rest = np.sqrt(np.maximum(self.largest**2 - norms, 0))
        return np.concatenate((vectors, rest[:, None]), axis=1)

    def nearest(self, points: np.ndarray, least: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found for each point, nearest first, and their distances (infinite where there are no more).

        Each point has at least ``least`` of them, and all found within ``ratio`` of its nearest one: where the last of a beam is still
        within it, the beam is made twice as wide and the search goes on.
        """
        total = len(self.centres)
        rows = max(1, _BLOCK // max(total, _EXPAND * self.graph.shape[1] * self.centres.shape[1]))
        parts = [self._search(points[i : i + rows], min(least, total), ratio) for i in range(0, len(points), rows)]
        width = max((found.shape[1] for found, _ in parts), default=0)
        lists, far = np.zeros((len(points), width), np.int64), np.full((len(points), width), np.inf)
        for i, (found, distances) in enumerate(parts):
            lists[i * rows : i * rows + len(found), : found.shape[1]] = found
            far[i * rows : i * rows + len(found), : found.shape[1]] = distances
        return lists, far

    def _search(self, points: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        total, each = len(self.centres), np.arange(len(points))
        squared = np.full((len(points), total), np.inf)
        squared[:, self.entry] = _squared(points, self.centres[self.entry])
        open_ = np.ones(squared.shape, bool)
        widths = np.full(len(points), width)
        going = each
        while len(going):
            widest = int(widths[going].max())
            beam = np.argpartition(squared[going], widest - 1, axis=1)[:, :widest]
            far = np.take_along_axis(squared[going], beam, 1)
            order = np.argsort(far, axis=1, kind="stable")
            beam, far = np.take_along_axis(beam, order, 1), np.take_along_axis(far, order, 1)
            # Beam members not looked at yet, nearest first; unseen centroids have no distance.
            waiting = open_[going[:, None], beam] & np.isfinite(far) & (np.arange(widest) < widths[going][:, None])
            wide = (far[np.arange(len(going)), widths[going] - 1] <= ratio**2 * far[:, 0]) & (widths[going] < total) & ~waiting.any(axis=1)
            widths[going[wide]] = np.minimum(2 * widths[going[wide]], total)
            first = waiting & (np.cumsum(waiting, axis=1) <= _EXPAND)
            row, col = np.nonzero(first)
            open_[going[row], beam[row, col]] = False
            row, centre = np.repeat(going[row], self.graph.shape[1]), self.graph[beam[row, col]].ravel()
            new = ~np.isfinite(squared[row, centre])
            row, centre = row[new], centre[new]
            apart = points[row] - self.centres[centre]
            squared[row, centre] = np.einsum("ij,ij->i", apart, apart)
            going = going[waiting.any(axis=1) | wide]
        widest = int(widths.max(initial=1))
        found = np.argsort(squared, axis=1, kind="stable")[:, :widest]
        return found, np.sqrt(np.take_along_axis(squared, found, 1))


def fit(vectors: DataFrame) -> Centroids | None:
    """Centroids from a bounded sample; None if there are no vectors."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    seen = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    if not seen["n"]:
        return None
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    count = min(MOST_LISTS, max(1, seen["n"] // LIST))
    return Centroids(_lists(sample), count, seen["largest"])


def _assign(rows: DataFrame, centroids, query: bool) -> DataFrame:
    """A row for each list that a vector joins, or that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = centroids.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                points = own.lifted(_lists(batch.column("v")), query)
                ratio = SEARCH_RATIO if query else REPLICA_RATIO
                lists, far = own.nearest(points, LEAST_LISTS if query else 2 * COPIES, ratio if query else 1.0)
                take = far <= ratio * far[:, :1] + 1e-12
                if query:
                    take[:, :LEAST_LISTS] = np.isfinite(far[:, :LEAST_LISTS])
                else:
                    take[:, COPIES:] = False
                row, col = np.nonzero(take)
                columns = [batch.column(n).take(pa.array(row)) for n in ("id", "v")]
                columns += [pa.array(lists[row, col].astype(np.int64)), pa.array(col < LEAST_LISTS)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "list", "near"])

    return rows.select("id", "v").mapInArrow(run, "id bigint, v array<double>, list bigint, near boolean")


def _best_of_piece(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ids, floor = _lists(left.column("v").combine_chunks()), left.column("id").to_numpy(), left.column("floor").to_numpy()
        vectors, names = _lists(right.column("v").combine_chunks()), right.column("id").to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(names):
            order = np.argsort(names, kind="stable")
            vectors, names = vectors[order], names[order]
            for start in range(0, len(ids), 256):
                some, own = queries[start : start + 256], ids[start : start + 256]
                rough = some @ vectors.T
                # One candidate may be the query itself, and rounding may shift the border.
                last = min(k + 1, len(names))
                border = np.maximum(-np.partition(-rough, last - 1, axis=1)[:, last - 1], floor[start : start + 256])
                slack = np.where(np.isfinite(border), 1e-9 * (1 + np.abs(border)), 0)
                q, c = np.nonzero((rough >= (border - slack)[:, None]) & (own[:, None] != names[None, :]))
                exact = (some[q] * vectors[c]).sum(axis=1)
                by = np.lexsort((names[c], -exact, q))
                q, c, exact = q[by], c[by], exact[by]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                keep = rank < k
                out.append((own[q[keep]], names[c[keep]], exact[keep]))
        parts = zip(*out) if out else ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, parts))))

    return run


def search(candidates: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest found for each row of ``usable`` that ``is_query`` (on ``id``) picks."""
    spark = candidates.sparkSession
    vectors = written(candidates, "ann-vectors")
    fitted = fit(vectors)
    if fitted is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    centroids = spark.sparkContext.broadcast(fitted)
    posted = written(_assign(vectors, centroids, False), "ann-lists")
    asked = written(_assign(vectors.filter(is_query), centroids, True), "ann-queries")
    # The nearest lists of a query are read first. What the others hold counts only if it reaches the score that those give.
    first = written(_met(asked.filter("near").withColumn("floor", F.lit(float("-inf"))), posted, k), "ann-found")
    floors = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("_rank", _ranked())
    floors = floors.filter(F.col("_rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = asked.filter("not near").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    once = first.union(_met(rest, posted, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", _ranked()).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _ranked() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def _met(asked: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """The best of each piece for the queries that read its list: a list's vectors are dealt to pieces and its queries to rows, and
    every piece meets every row once."""
    sizes = posted.groupBy("list").count().select("list", F.ceil(F.col("count") / PIECE).alias("pieces"))
    sizes = sizes.join(asked.groupBy("list").count().select("list", F.ceil(F.col("count") / PIECE).alias("rows")), "list")

    def dealt(rows: DataFrame, own: str, own_count: str, other: str, other_count: str, *more: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_count) - 1))
        placed = rows.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_count))).withColumn(other, every)
        return placed.select("list", "piece", "row", "id", "v", *more)

    seeking = dealt(asked, "row", "rows", "piece", "pieces", "floor").groupBy("list", "piece", "row")
    held = dealt(posted, "piece", "pieces", "row", "rows").groupBy("list", "piece", "row")
    return seeking.cogroup(held).applyInArrow(_best_of_piece(k), "query_id bigint, vec_id bigint, score double")
