"""Per-dialogue ordering without putting a whole dialogue into one task.

A plain ``Window.partitionBy(dialogue)`` sends every row of a dialogue to one task, so one dialogue
or run holding a large share of the table stalls the job. Here the key is refined by a span: a
range of at most ``span`` consecutive values of an integer order column. Rows are shuffled once by
(key, span); what crosses span borders is either a small per-span total (positions, running sums)
or the few rows before the border (trailing windows).

The order column is a bigint that is unique within its key (a turn or a step number), so a span
never holds more than ``span`` rows. Where order values lie far apart (ids that all keys share), ``scans`` takes
its borders from the data instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SPAN = 65536


def _span_start(order: Column, span: int) -> Column:
    return order - F.pmod(order, F.lit(span))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    span: int = SPAN,
) -> DataFrame:
    """Inclusive running total of ``value`` along ``order`` within ``keys``, as column ``out``.

    Rows without a key stay, with a null total.
    """
    keys = list(keys)
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    valued = df.withColumn("_value", value).withColumn("_span", _span_start(F.col(order), span))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    # A key that fits one span carries nothing, so this side is small however many keys there are.
    carried = (
        valued.groupBy(*keys, "_span")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_span", F.sum("_total").over(before).alias("_carried"))
        .filter("_carried is not null")
    )
    within = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        valued.withColumn("_inside", F.sum("_value").over(within))
        .join(carried, [*keys, "_span"], "left")
        .withColumn(out, F.when(keyed, F.col("_inside") + F.coalesce("_carried", F.lit(0))))
        .select(*df.columns, out)
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "position",
    span: int = SPAN,
) -> DataFrame:
    """Dense 0-based position of each row along ``order`` within ``keys``."""
    counted = running_sum(df, keys, order, F.lit(1), out, span)
    return counted.withColumn(out, F.col(out) - 1)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    size: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    span: int = SPAN,
) -> DataFrame:
    """Add columns computed over each row and the ``size - 1`` rows before it.

    ``position`` must be dense. The last ``size - 1`` rows of a span are also sent to the next span,
    where they only serve as context and are dropped after the window.
    """
    if size < 1:
        raise ValueError("a trailing window holds at least the row itself")
    span = max(span, size)
    keys = list(keys)
    home = _span_start(F.col(position), span)
    near_border = F.pmod(F.col(position), F.lit(span)) > span - size
    spread = df.withColumn("_home", home).withColumn(
        "_span",
        F.explode(
            F.when(near_border, F.array("_home", F.col("_home") + span)).otherwise(F.array("_home"))
        ),
    )
    frame = Window.partitionBy(*keys, "_span").orderBy(position).rowsBetween(1 - size, 0)
    return spread.withColumns(build(frame)).filter("_span = _home").drop("_span", "_home")
