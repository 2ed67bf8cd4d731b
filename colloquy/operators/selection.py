"""Exact selection by weight: where the order of ranks reaches a total, found by bisection.

Groups are put in the order of their rank (a hash) and key. A cut is the last group of the longest start of that order
whose weights do not exceed a target. It is found from histograms: one aggregation over ``BINS`` even ranges of ranks says in which
range the cut lies, the next one divides that range, until it holds few enough groups to look at each. A pass
sends at most ``BINS`` rows per task and to the driver, and a row is then compared with the cut, without a join or a sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators import scans

BINS = 4096
#: Half of a 64-bit rank, so that differences of two fit a long.
_LOW, _HIGH = -(1 << 62), (1 << 62) - 1

Place = tuple[Any, ...]


def _half(rank: str) -> Column:
    return F.shiftright(F.col(rank), 1)


def _bins(groups: DataFrame, rank: str, weight: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """``(low, high, weight, groups)`` of the ranges between two half ranks that hold any group, in order."""
    width = (high - low) // BINS + 1
    inside = groups.filter(_half(rank).between(low, high)).withColumn("_half", _half(rank))
    found = (
        inside.groupBy(F.expr(f"(_half - ({low}L)) div {width}L").alias("_bin"))
        .agg(F.min("_half").alias("low"), F.max("_half").alias("high"), F.sum(weight).alias("weight"), F.count("*").alias("n"))
        .collect()
    )
    return sorted((r["low"], r["high"], r["weight"], r["n"]) for r in found)


def cuts(groups: DataFrame, rank: str, keys: Sequence[str], weight: str, targets: Sequence[Any]) -> list[Place | None]:
    """For each target the place ``(rank, *keys)`` of the last group of the longest start that weighs no more; None if none does.

    A target is a number or a function of the total weight. ``rank`` is a bigint, weights are positive, and ``keys`` are unique.
    """
    first = _bins(groups, rank, weight, _LOW, _HIGH)
    total = sum(b[2] for b in first)
    wanted = [target(total) if callable(target) else target for target in targets]
    return [_cut(groups, rank, list(keys), weight, target, first) for target in wanted]


def _cut(groups: DataFrame, rank: str, keys: list[str], weight: str, target: int, bins) -> Place | None:
    before = 0
    reached = None  # the range of the last group that fits for sure
    while True:
        at = None
        for low, high, size, n in bins:
            if before + size > target:
                at = (low, high, n)
                break
            before += size
            reached = (low, high)
        if at is None:
            return _last(groups, rank, keys, *reached) if reached else None
        low, high, n = at
        if n <= BINS or low == high:
            break
        bins = _bins(groups, rank, weight, low, high)
    inside = groups.filter(_half(rank).between(low, high)).select(rank, *keys, F.col(weight).alias("_weight"))
    found = _walked(inside, [rank, *keys], target - before) if n <= BINS else _scanned(inside, [rank, *keys], target - before)
    if found is not None:
        return found
    return _last(groups, rank, keys, *reached) if reached else None


def _walked(inside: DataFrame, place: list[str], left: int) -> Place | None:
    found = None
    for *at, weight in inside.orderBy(*place).collect():
        left -= weight
        if left < 0:
            break
        found = tuple(at)
    return found


def _scanned(inside: DataFrame, place: list[str], left: int) -> Place | None:
    """The same for many groups of one rank, without one task seeing all."""
    placed = inside.select(F.lit(1).alias("_all"), F.struct(*place).alias("_place"), "_weight")
    summed = scans.running_sums(placed, ["_all"], "_place", _through=F.col("_weight"))
    found = summed.filter(F.col("_through") <= left).agg(F.max("_place").alias("p")).first()["p"]
    return None if found is None else tuple(found)


def _last(groups: DataFrame, rank: str, keys: list[str], low: int, high: int) -> Place:
    return tuple(groups.filter(_half(rank).between(low, high)).agg(F.max(F.struct(rank, *keys)).alias("p")).first()["p"])


def up_to(place: Place | None, rank: str, keys: Sequence[str], df: DataFrame) -> Column:
    """Whether a row's group stands at or before a cut."""
    if place is None:
        return F.lit(False)
    fields = [rank, *keys]
    limit = F.struct(*[F.lit(v).cast(df.schema[f].dataType).alias(f) for f, v in zip(fields, place)])
    return F.struct(*fields) <= limit
