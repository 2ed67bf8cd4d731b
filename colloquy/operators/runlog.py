"""Training-run log analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators import scans
from colloquy.schemas import RUN_EVENT

SAVE_STEPS = 50


def run_log_rows(raw: DataFrame, line: str = "line") -> DataFrame:
    """Typed log rows of raw JSON log events; keys an event does not carry are null."""
    return raw.select(F.from_json(line, RUN_EVENT).alias("e")).select("e.*")


def run_summary(log: DataFrame, *keys: str, step: str = "step") -> DataFrame:
    """One row per run. Every field is an aggregate with partial state, so a hot run is no problem."""
    has_loss = F.when(F.col("loss").isNotNull(), F.col(step))
    has_rate = F.when(F.col("learning_rate").isNotNull(), F.col(step))
    return log.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.max(step).alias("total_steps"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.max_by("loss", has_loss).alias("final_loss"),
        F.min("loss").alias("best_loss"),
        F.min_by("learning_rate", has_rate).alias("initial_learning_rate"),
        F.max_by("learning_rate", has_rate).alias("final_learning_rate"),
        F.max("epoch").alias("final_epoch"),
    ).withColumn("duration_seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def moving_average_loss(
    log: DataFrame, size: int, key: str, order: str, *, value: str = "loss", out: str = "moving_avg_loss"
) -> DataFrame:
    """Mean loss over the last ``size`` log events that carry one. ``order`` is unique within a run.

    Steps may lie far apart, so ranges of rows are cut where a sample says.
    """
    return scans.trailing(null_safe_series(log, value), [key], order, size, lambda w: {out: F.avg(value).over(w)})


def device_metrics(nested: DataFrame, *keys: str) -> DataFrame:
    """One row per timestamp and device of a nested device log."""
    return nested.select(*keys, F.inline("gpu_metrics")).select(*keys, "timestamp", F.inline("metrics"))


def device_peaks(devices: DataFrame, *keys: str) -> DataFrame:
    return devices.groupBy(*keys).agg(
        F.max("vram_used").alias("peak_vram"), F.max("utilization").alias("peak_utilization")
    )


def save_point(step: Column, every: int = SAVE_STEPS) -> Column:
    """Number of the save interval a step falls into."""
    return F.floor(step / F.lit(every)).cast("bigint")


def interval_rollup(log: DataFrame, key: str = "run_id", every: int = SAVE_STEPS) -> DataFrame:
    """Roll-up per run and save interval; the same on a batch and on a stream."""
    return log.groupBy(key, save_point(F.col("step"), every).alias("save_interval")).agg(
        F.count("*").alias("n_events"),
        F.max("step").alias("last_step"),
        F.min("loss").alias("min_loss"),
        F.max("loss").alias("max_loss"),
    )


def null_safe_series(log: DataFrame, *columns: str) -> DataFrame:
    """Rows in which the given columns have values."""
    return log.na.drop(subset=list(columns))


def select_series(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    return null_safe_series(log.select(*columns), *columns)
