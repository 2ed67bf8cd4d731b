"""Sinks. Every write replaces its own target, so a repeated job leaves the same result."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ratings import RATING_KEYS, latest_ratings
from colloquy.schemas import METRICS
from colloquy.session import stored

#: Files that a task writes where each row is a file of its own: making one takes far longer than its bytes do.
FILES_PER_TASK = 500


def _dealt(documents: DataFrame) -> DataFrame:
    """Documents computed once and dealt to as many tasks as their files need; their bytes alone would call for few."""
    documents = stored(documents, "documents")
    tasks = max(-(-documents.count() // FILES_PER_TASK), documents.sparkSession.sparkContext.defaultParallelism)
    return documents.repartition(tasks)


def write_file_each(texts: DataFrame, path: str) -> None:
    """Each row of a single text column added to the folder as a file of its own."""
    _dealt(texts).write.mode("append").option("maxRecordsPerFile", 1).text(path)


def write_chat_corpus(examples: DataFrame, path: str) -> None:
    """JSON lines, one example per line."""
    examples.write.mode("overwrite").json(path)


def scored_dialogues(pairs: DataFrame, ratings: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Nested rating rows ``(key, pair_id, prompt, response, evaluation)``, one per pair.

    ``nest_dialogues`` makes the stored documents of them.
    """
    blank = F.struct(F.lit("").alias("quantitative"), F.lit("").alias("qualitative"))

    def verdict(metric: str):
        of_metric = F.when(F.col("metric_type") == metric, F.struct("quantitative", "qualitative"))
        return F.coalesce(F.max(of_metric), blank).alias(metric)

    per_pair = ratings.groupBy(key, "pair_num").agg(F.struct(*[verdict(m) for m in METRICS]).alias("evaluation"))
    joined = pairs.join(per_pair, (pairs[key] == per_pair[key]) & (pairs["pair_id"] == per_pair["pair_num"]), "left")
    unrated = F.struct(*[blank.alias(m) for m in METRICS])
    return joined.select(
        pairs[key], "pair_id", "prompt", "response", F.coalesce("evaluation", unrated).alias("evaluation")
    )


def nest_dialogues(
    scored: DataFrame, metadata: DataFrame, key: str = "dialogue_id", chunk_pairs: int | None = None
) -> DataFrame:
    """Documents ``(metadata, pairs)`` as ``read_scored_dialogues`` reads them.

    ``metadata`` holds one struct per dialogue. A dialogue is one document; with ``chunk_pairs`` it is as many as it needs, each with the
    same metadata and up to that many pairs, so no cell holds a long dialogue.
    """
    pair = F.struct(
        F.col("pair_id").cast("bigint").alias("pair_id"),
        F.struct(F.col("prompt").alias("content")).alias("claude"),
        F.struct(F.col("response").alias("content")).alias("gemma"),
        "evaluation",
    )
    chunk = F.lit(0) if chunk_pairs is None else F.floor((F.col("pair_id") - 1) / chunk_pairs)
    documents = scored.groupBy(key, chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    return documents.join(metadata.select(key, "metadata"), key).select("metadata", "pairs")


def write_scored_dialogues(documents: DataFrame, path: str, one_per_file: bool = False) -> None:
    """Nested documents as JSON lines, or as one JSON file each."""
    writer = (_dealt(documents) if one_per_file else documents).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", 1) if one_per_file else writer).json(path)


def route_low_rated(transcripts: DataFrame, verdicts: DataFrame, path: str, key: str = "dialogue") -> None:
    """Write transcripts below ``path``/rating_bucket=<verdict>; the source is left alone."""
    (
        transcripts.join(verdicts.select(key, F.col("verdict").alias("rating_bucket")), key, "left")
        .withColumn("rating_bucket", F.coalesce("rating_bucket", F.lit("unrated")))
        .write.mode("overwrite")
        .partitionBy("rating_bucket")
        .parquet(path)
    )


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").csv(path, header=True)


def write_run_log(log: DataFrame, path: str) -> None:
    """Metrics as CSV and the full history as JSON."""
    log.write.mode("overwrite").csv(f"{path}/metrics", header=True)
    log.write.mode("overwrite").json(f"{path}/history")


def append_rating_load(ratings: DataFrame, path: str, load_id: int, writer: str = "batch") -> None:
    """Add one load to the rating store; the same writer's same load replaces itself and nothing else.

    Loads are immutable side by side, so no upsert rewrites the store and a lost executor or a
    repeated batch cannot damage other loads. Loads are ordered by the time they were written.
    """
    stamped = ratings.withColumn("loaded_at", F.lit(time.time_ns()))
    stamped.write.mode("overwrite").parquet(f"{path}/writer={writer}/load={load_id}")


def _loads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("writer", "load")


def current_ratings(
    spark: SparkSession, path: str, keys: Sequence[str] = RATING_KEYS, value: str = "score"
) -> DataFrame:
    """The store as of its last load: per rating the latest score."""
    return latest_ratings(_loads(spark, path), keys, value, "loaded_at")


def replaced_ratings(spark: SparkSession, path: str, key: str = RATING_KEYS[0]) -> DataFrame:
    """The store where a load replaces all ratings of the dialogues it holds, as two-metric answers do."""
    loads = _loads(spark, path)
    last = loads.groupBy(key).agg(F.max("loaded_at").alias("loaded_at"))
    return loads.join(last, [key, "loaded_at"], "left_semi").drop("loaded_at")


def compact_rating_store(spark: SparkSession, path: str, new_path: str, load_id: int) -> None:
    """Fold all loads into one, in a new place."""
    append_rating_load(current_ratings(spark, path), new_path, load_id)
