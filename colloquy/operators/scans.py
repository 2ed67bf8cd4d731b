"""Prefix scans and trailing windows over ranges of (key, order) that hold about equally many rows.

``spans`` cuts dense numbers into even spans. Where order values lie anywhere (ids that all runs share, places in a file), even
spans are uneven in rows, so the borders come from the data: rows are sampled by a hash of (key, order), and every
``PER_RANGE``-th sampled row in that order is a border. A key without a border is one range; a key that
holds a third of the rows has a third of the borders. All keys are treated alike, at every size.

Rows are shuffled once, by (key, range). What crosses a border is small: a total for each range of a key that has borders, or
the ``size - 1`` rows on both sides of a border. Borders are at most ``ranges`` (by default four for each shuffle
partition), so joining them and the totals by broadcast has a bound that does not grow with the data.

The order column may have any type that Spark sorts and hashes, and is unique within its key. Null keys form a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PER_RANGE = 32
RANGES_PER_PARTITION = 4


def _default_ranges(df: DataFrame) -> int:
    return RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _named(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def _matched(df: DataFrame, other: DataFrame, keys: Sequence[str], prefix: str, *more: Column) -> DataFrame:
    """Left join on null-safe keys with a side of bounded size."""
    same = [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)]
    joined = df.join(F.broadcast(other), reduce(lambda a, b: a & b, [*same, *more]), "left")
    return joined.drop(*[f"{prefix}{i}" for i in range(len(keys))])


def borders(df: DataFrame, keys: Sequence[str], order: str, ranges: int) -> DataFrame:
    """``(keys, _borders)``: the first order values of all ranges of a key but its first, ascending."""
    step = F.greatest(F.floor(df.agg(F.count("*")).scalar() / (ranges * PER_RANGE)), F.lit(1))
    sample = df.select(*_named(keys, "_b"), F.col(order).alias("_o")).filter(F.pmod(F.xxhash64(*keys, order), step) == 0)
    names = [f"_b{i}" for i in range(len(keys))]
    # about ranges * PER_RANGE rows, so their order is one small task
    ranked = sample.withColumn("_nth", F.row_number().over(Window.orderBy(*names, "_o")))
    return ranked.filter(F.col("_nth") % PER_RANGE == 0).groupBy(*names).agg(F.sort_array(F.collect_list("_o")).alias("_borders"))


def ranged(df: DataFrame, keys: Sequence[str], order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``, the number of the key's borders up to the row, and ``_cut``, whether its key has any."""
    ranges = ranges or _default_ranges(df)
    marked = _matched(df, borders(df, keys, order, ranges), keys, "_b")
    # Binary search: the sample may exceed its mean, hence one step more.
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length() + 1))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get("_borders", at + step - 1) <= F.col(order), at + step).otherwise(at),
    )
    cut = F.col("_borders").isNotNull()
    return marked.withColumns({"_range": F.when(cut, found).otherwise(0), "_cut": cut}).drop("_borders")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, ranges: int | None = None, **sums: Column
) -> DataFrame:
    """Add inclusive running totals along ``order`` within ``keys``, one column for each of ``sums``."""
    keys = list(keys)
    valued = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    rows = ranged(valued, keys, order, ranges)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.filter("_cut").groupBy(*keys, "_range").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    carried = totals.select(
        *_named(keys, "_c"), F.col("_range").alias("_r"), *[F.sum(f"_t_{name}").over(before).alias(f"_t_{name}") for name in sums]
    )
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_v_{name}": F.sum(f"_v_{name}").over(within) for name in sums})
    placed = _matched(inside, carried, keys, "_c", F.col("_range") == F.col("_r"))
    return placed.select(*df.columns, *[(F.col(f"_v_{n}") + F.coalesce(f"_t_{n}", F.lit(0))).alias(n) for n in sums])


def with_position(df: DataFrame, keys: Sequence[str], order: str, out: str = "position", ranges: int | None = None) -> DataFrame:
    """Dense 0-based position of each row along ``order`` within ``keys``."""
    counted = running_sums(df, keys, order, ranges, **{out: F.lit(1).cast("bigint")})
    return counted.withColumn(out, F.col(out) - 1)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    size: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    ranges: int | None = None,
) -> DataFrame:
    """Add columns computed over each row and the ``size - 1`` rows before it.

    Within a range a window has all it needs from the ``size``-th row on. The rows before that, and the last ``size - 1`` of each
    range as what stands in front of them, are computed again by key alone: they are at most ``2 * size`` for each border.
    """
    if size < 1:
        raise ValueError("a trailing window holds at least the row itself")
    keys = list(keys)
    part = Window.partitionBy(*keys, "_range")
    along = part.orderBy(order)
    rows = ranged(df, keys, order, ranges).withColumns(
        build(along.rowsBetween(1 - size, 0)) | {"_front": F.row_number().over(along), "_size": F.count("*").over(part)}
    )
    early = F.col("_cut") & (F.col("_range") > 0) & (F.col("_front") < size)
    late = F.col("_cut") & (F.col("_size") - F.col("_front") < size - 1)
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    edges = rows.filter(early | late).withColumns(build(frame))
    columns = [*df.columns, *[c for c in build(frame) if c not in df.columns]]
    return rows.filter(~early).select(*columns).unionByName(edges.filter(early).select(*columns))
