"""Whitening of embeddings by shifted CholeskyQR over distributed Gram passes.

Entries become whole numbers x = floor(``SCALE`` * c) + ``OFFSET``. With n vectors and their sums S, a centred row is (n * x - S) / n,
taken from whole numbers, so that no digit is lost to the offset. The centred rows A are never gathered: each pass reads
the table once, and a task adds up the Gram matrix of its rows after the triangular solves of all passes before:

1. G = A'A, its Cholesky factor R1 of G + shift * I, which exists whatever the condition of A;
2. G of Q1 = A / R1, with factor R2; 3. G of Q2 = Q1 / R2, with factor R3. Passes go on until G is the identity to ``CLOSE``.

Q of the last pass is orthonormal to double precision, and A = Q R with R = R3 R2 R1. The singular value decomposition of R,
a matrix of the size of one vector squared, gives the covariance's eigenvectors W and eigenvalues e = s^2 / n without squaring the
condition. Dimensions that are combinations of others (up to ``RANK`` of the largest variance) take no part in Q; their columns of R
are Q'A, from one pass more. Directions without variance have no component, so there may be fewer than asked.

Partial Gram matrices are cut into blocks of rows and added up in two steps, so no task gets all partial sums of a large table.
What comes to the driver and goes to the tasks has the size of a vector squared.

Rows whose vector is null, empty, or holds null or non-finite entries take no part; nor do entries beyond ``MOST``, whose whole numbers
a double cannot hold, and vectors of another length than the most common one (ties: the shorter). Null ids are carried; repeated rows each
count. One vector, or equal ones, have no variance and give no rows, as does an empty table. ``deviation`` is null where it does not fit a
long. Only the id and the vector are read, so other columns cannot clash. Tables are small beside the input: x as numbers near ``OFFSET``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.store import written

SCALE = 64
OFFSET = 1_000_000
MOST = float(2**40)
COMPONENTS = 32
CLOSE = 1e-13
RANK = 1e-12
MOST_PASSES = 8
#: Rows that a task handles at once, doubles of a block of a partial Gram matrix, and sums added by one task of the first step.
_ROWS = 4096
_BLOCK = 4096
_FAN = 64


class Whitening(NamedTuple):
    """What a fit finds: ``axes`` holds a component a column, ``values`` their eigenvalues, ``share`` these by the trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    share: np.ndarray
    passes: int


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``x`` (longs) of the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    usable = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > MOST)) & (F.size(vector) > 0)
    good = rows.filter(F.col(vector_col).isNotNull()).filter(usable)
    x = F.transform(vector, lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("bigint"))
    good = good.select(F.col(id_col).alias("id"), x.alias("x"))
    size = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("x") == (size["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centre(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S / n: the whole part of the mean is taken off in whole numbers, then the rest."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q with Q ``upper`` = ``rows``: substitution column by column, by blocks of 32 columns."""
    out = np.empty_like(rows)
    for start in range(0, upper.shape[0], 32):
        stop = min(start + 32, upper.shape[0])
        block = rows[:, start:stop] - out[:, :start] @ upper[:start, start:stop]
        for j in range(start, stop):
            out[:, j] = (block[:, j - start] - out[:, start:j] @ upper[start:j, j]) / upper[j, j]
    return out


def _gram(rows: DataFrame, width: int, left: Callable, right: Callable | None) -> np.ndarray:
    """The sum of ``left(x)' right(x)`` (of ``left`` twice without ``right``) over all rows; ``width`` rows, added up in tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                x = _matrix(whole.column("x").slice(start, _ROWS))
                a = left(x)
                product = a.T @ (a if right is None else right(x))
                total = product if total is None else total + product
        if total is not None:
            flat = total.ravel()
            parts = [flat[i : i + _BLOCK] for i in range(0, len(flat), _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.list_(pa.float64()))], names=["block", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks()
        total = np.zeros(len(sums[0].as_py()))
        for row in sums:
            total += row.values.to_numpy()
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.select("x").mapInArrow(partial, "block bigint, sums array<double>").withColumn("salt", F.spark_partition_id() % _FAN)
    sums = sums.groupBy("block", "salt").applyInArrow(added, "block bigint, sums array<double>")
    blocks = {r["block"]: r["sums"] for r in sums.groupBy("block").applyInArrow(added, "block bigint, sums array<double>").collect()}
    return np.concatenate([blocks[b] for b in sorted(blocks)]).reshape(width, -1)


def _independent(gram: np.ndarray) -> list[int]:
    """Columns that span all, by Cholesky with the largest rest first; in ascending order."""
    rest = gram.copy()
    scale = np.where(np.diag(gram) > 0, np.sqrt(np.diag(gram)), 1)
    rest = rest / scale[:, None] / scale[None, :]
    found: list[int] = []
    while True:
        left = np.diag(rest).copy()
        left[found] = 0
        j = int(left.argmax()) if len(left) else 0
        if not len(left) or left[j] <= RANK:
            return sorted(found)
        found.append(j)
        row = rest[j] / np.sqrt(left[j])
        rest = rest - np.outer(row, row)


def fit(numbers: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows of ``whole_numbers``; None if they have no variance."""
    # Sums per dimension in whole numbers; a decimal holds them however many rows there are.
    each = numbers.select(F.posexplode("x").alias("at", "x")).groupBy("at")
    totals = each.agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("sum"), F.count("*").alias("n")).orderBy("at").collect()
    if not totals:
        return None
    n, exact = totals[0]["n"], tuple(int(r["sum"]) for r in totals)
    rows = _centre(n, exact)
    full = _gram(numbers, len(exact), rows, None)
    columns = _independent(full)
    if not columns:
        return None
    gram, factors = full[np.ix_(columns, columns)], []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = rows(x)[:, columns]
        for factor in factors:
            q = solved(q, factor)
        return q

    unit = np.finfo(float).eps / 2
    size = len(columns)
    shift = 11 * (n * size + size * (size + 1)) * unit * np.linalg.norm(gram, 2)
    while True:
        # Unlike scales of the dimensions are harmless to Cholesky; the shift takes care of dependence alone.
        shifted = gram + min(shift, np.diag(gram).max()) * np.eye(size) if not factors else gram
        try:
            factors.append(np.linalg.cholesky(shifted).T)
        except np.linalg.LinAlgError:
            factors.append(np.linalg.cholesky(gram + 100 * size * unit * np.linalg.norm(gram, 2) * np.eye(size)).T)
        gram = _gram(numbers, size, orthogonal, None)
        if np.abs(gram - np.eye(size)).max() <= CLOSE * max(1, size / 64) or len(factors) >= MOST_PASSES:
            break
    if size < len(exact):
        composed = _gram(numbers, size, orthogonal, rows)
    else:
        composed = factors[0]
        for factor in factors[1:]:
            composed = factor @ composed
    singular, axes = np.linalg.svd(composed, full_matrices=False)[1:]
    values = singular**2 / n
    take = min(components, int((values > RANK * values[0]).sum()))
    axes = axes[:take].T
    # Either sign would do; the largest entry is made positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(take)])
    return Whitening(n, exact, axes, values[:take], values[:take] / values.sum(), len(factors))


def _project(found: Whitening):
    centred, scaled = _centre(found.n, found.sums), found.axes / np.sqrt(found.values)
    return lambda x: centred(x) @ scaled


def identity_error(numbers: DataFrame, found: Whitening) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity, over all rows."""
    project = _project(found)

    def with_ones(x: np.ndarray) -> np.ndarray:
        return np.concatenate((project(x), np.ones((len(x), 1))), axis=1)

    gram = _gram(numbers, len(found.values) + 1, with_ones, None) / found.n
    mean = gram[:-1, -1]
    return float(np.abs(gram[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
    whole = np.array([s // n for s in sums], np.int64)
    apart = x - whole
    bound = int(np.abs(apart).max(initial=0)) + 1
    if bound * n < 2**31 and (bound * n) ** 2 * x.shape[1] < 2**63:
        scaled = apart * n - np.array([s % n for s in sums], np.int64)
        return (scaled * scaled).sum(axis=1).tolist()
    scaled = apart.astype(object) * n - np.array([s % n for s in sums], object)
    return [d if d < 2**63 else None for d in (scaled * scaled).sum(axis=1).tolist()]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: the id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    numbers = written(whole_numbers(rows, id_col, vector_col), "whitening-numbers")
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = fit(numbers, components)
    if found is None:
        return spark.createDataFrame([], schema)
    error, project, count = identity_error(numbers, found), _project(found), len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                x = _matrix(part.column("x"))
                each = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), found.n)), pa.array(_deviations(x, found.n, found.sums), pa.int64()).take(pa.array(each)),
                        pa.array(project(x).ravel()), pa.array(np.tile(found.share, len(x))), pa.array(np.full(len(each), error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return numbers.mapInArrow(run, schema)
