"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "colloquy", shared: str | None = None) -> SparkSession:
    """Session for tests and the bench, with the shared folder they set up; a cluster brings its own."""
    builder = SparkSession.builder.config(CHECKPOINT_DIR, shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder path under the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session, and where it is unset the warehouse folder. Whoever
    sets them up clears them.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that every executor can reach")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once for all steps that read them, and safe from lost executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
