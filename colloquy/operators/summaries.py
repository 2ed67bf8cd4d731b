"""Summaries that merge: a load updates them without the ratings of earlier loads.

A state row holds, for one group, the count, mean, sum of squared deviations, least and greatest score, and a KLL quantile sketch. States of
disjoint parts merge to the state of their union, in any order: moments by the pairwise update, which does not
subtract large sums, sketches by their own merge. Mean, deviation, least, greatest and count are those of the batch; quantiles
are within ``RANK_ERROR`` of their rank.

Null scores count nowhere, so a group of nulls alone has no state. Null keys are a group of their own. An empty table has no states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.analytics import BASE, CHECKPOINT, MODEL

#: Size of the sketch, and the rank error it stays within (with a chance of 99 %).
SKETCH_SIZE = 200
RANK_ERROR = 0.0165
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
GROUP = (MODEL, CHECKPOINT, "metric_type")

_STATE = ("n", "mean", "m2", "min", "max", "sketch")


def summary_states(ratings: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """``(keys, n, mean, m2, min, max, sketch)`` of a load."""
    keys = keys or GROUP
    known = ratings.filter(F.col(score).isNotNull()).withColumn(score, F.col(score).cast("double"))
    return known.groupBy(*keys).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        (F.var_pop(score) * F.count(score)).alias("m2"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.kll_sketch_agg_double(score, F.lit(SKETCH_SIZE)).alias("sketch"),
    )


def _merged_moments(states: Column) -> Column:
    """Pairwise update of (n, mean, m2) over the states of a group, one for each load that is merged."""

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"),
        )

    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.sort_array(states), nothing, add)


def merge_states(*states: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """States of the union of disjoint parts, from the states of the parts."""
    together = states[0].select(*keys, *_STATE)
    for more in states[1:]:
        together = together.unionByName(more.select(*keys, *_STATE))
    moments = _merged_moments(F.collect_list(F.struct("n", "mean", "m2")))
    merged = together.groupBy(*keys).agg(
        moments.alias("_m"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    return merged.select(*keys, "_m.*", "min", "max", "sketch")


def summary_of_states(states: DataFrame, keys: Sequence[str] = GROUP, digits: int | None = 3) -> DataFrame:
    """What ``analytics.summary_stats`` gives for the ratings that the states stand for."""

    def rounded(c: Column) -> Column:
        return c if digits is None else F.bround(c, digits)

    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return states.select(
        *keys, rounded(F.col("mean")).alias("mean"), rounded(deviation).alias("std"), "min", "max", F.col("n").alias("count")
    )


def quartiles_of_states(states: DataFrame, keys: Sequence[str] = GROUP, at: Sequence[float] = QUARTILES) -> DataFrame:
    """``(keys, quantile, value, n)``: a row for each quantile, within ``RANK_ERROR`` of its rank."""
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in at]))
    pairs = F.arrays_zip(F.array(*[F.lit(q) for q in at]).alias("q"), values.alias("v"))
    return states.select(*keys, "n", F.explode(pairs).alias("p")).select(
        *keys, F.col("p")["q"].alias("quantile"), F.col("p")["v"].alias("value"), "n"
    )


def rating_cube(ratings: DataFrame) -> DataFrame:
    """Mean, deviation and count by model and metric, by either and in total, with the gain over the base: one scan.

    ``level`` tells which: ``model_metric``, ``model``, ``metric`` or ``total``. ``improvement`` is the mean less that of the base model at the same
    level and metric, for other models.
    """
    level = F.element_at(F.array(*[F.lit(x) for x in ("model_metric", "model", "metric", "total")]), (F.grouping_id() + 1).cast("int"))
    cells = ratings.cube(MODEL, "metric_type").agg(
        level.alias("level"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("score").alias("n")
    )
    # The cube has a row for each model and metric, so this window is small; ratings are not read again.
    of_model = F.col("level").isin("model_metric", "model")
    is_base = of_model & F.col(MODEL).eqNullSafe(BASE)
    base = F.max(F.when(is_base, F.col("mean"))).over(Window.partitionBy("level", "metric_type"))
    return cells.withColumn("improvement", F.when(of_model & ~is_base, F.col("mean") - base))
