"""Helpers that keep the optimizer from computing costly expressions more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An array that a lambda refers to is otherwise inlined into the lambda by the optimizer and
    computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters do not compute again.

    A filter on a plain computed column is pushed below it, and the expression then runs in the
    filter and in the projection. A filter on generated columns stays above their generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def exploded(df: DataFrame, array: str, *keep: str, pos: str = "_pos", item: str = "_item") -> DataFrame:
    """One row per element of a computed array, with its position.

    The outer form is used because the inner one adds a filter on the array's size, which is pushed
    down and computes the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
