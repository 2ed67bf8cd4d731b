"""Structured Streaming versions of the incremental jobs.

Every query takes its checkpoint folder from the caller, who picks it under the shared folder of
the cluster. Sinks are repeatable per batch, so a restarted query leaves the same result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.ratings import long_ratings, parse_two_metric
from colloquy.operators.runlog import SAVE_STEPS, interval_rollup
from colloquy.operators.transcripts import explode_turns, with_turns
from colloquy.sources.writers import append_rating_load


def state_session(spark: SparkSession) -> SparkSession:
    """Session for stateful queries: no more state partitions than the cluster has cores.

    Every state partition is committed in every batch, and their number is fixed by the first batch.
    """
    session = spark.newSession()
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", max(wanted, 1))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def stream_turns(documents: DataFrame, out: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Parse the transcripts that are new since the last run; stateless."""
    turns = explode_turns(with_turns(documents), *keys)
    return (
        turns.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def stream_ratings(
    answers: DataFrame, store: str, checkpoint: str, key: str = "dialogue_id", config: DataFrame | None = None
) -> StreamingQuery:
    """Parse new judge answers and add them to the rating store, one load per batch.

    Loads carry the stream's own name, taken from its checkpoint, so streams with one store do not meet.
    Answers for dialogues that ``config`` does not list are left out.
    """
    writer = hashlib.md5(checkpoint.encode()).hexdigest()
    if config is not None:
        answers = answers.join(config.select(key).distinct(), key, "left_semi")
    ratings = long_ratings(parse_two_metric(answers, key)).select(key, "metric_type", "pair_num", "score")
    return (
        ratings.writeStream.foreachBatch(lambda batch, batch_id: append_rating_load(batch, store, batch_id, writer))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_run_log(
    log: DataFrame, out: str, checkpoint: str, key: str = "run_id", every: int = SAVE_STEPS
) -> StreamingQuery:
    """Roll-up per run and save interval in update mode; each batch writes the groups it changed."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        interval_rollup(log, key, every)
        .writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rollup(spark: SparkSession, out: str, key: str = "run_id") -> DataFrame:
    """Latest state of every group that ``stream_run_log`` has written."""
    batches = spark.read.parquet(out)
    values = [c for c in batches.columns if c not in (key, "save_interval", "batch")]
    return (
        batches.groupBy(key, "save_interval")
        .agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        .select(key, "save_interval", "_v.*")
    )


def windowed_rollup(log: DataFrame, width: str = "1 day", delay: str = "1 hour", key: str = "run_id") -> DataFrame:
    """Event-time roll-up; on a stream the watermark closes windows and frees their state."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), key)
        .agg(F.count("*").alias("n_events"), F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"))
        .select(
            key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "min_loss", "max_loss"
        )
    )


def stream_windows(log: DataFrame, out: str, checkpoint: str, width: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Closed windows only, appended to a parquet table."""
    return (
        windowed_rollup(log, width, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
