"""File sources as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.scores import null_token
from colloquy.functions.text import fold_newlines
from colloquy.schemas import CATALOG_ITEM, CHAT_EXAMPLE, DEVICE_LOG, RUN_CONFIG_TYPES, SCORED_DIALOGUE

TRANSCRIPT_GLOB = "*.txt"


def _with_file(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        fold_newlines(F.col("value")).alias("content"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, path, modified, content)``, one row per ``*.txt`` file."""
    return _with_file(spark.read.text(path, wholetext=True, pathGlobFilter=TRANSCRIPT_GLOB))


def read_transcripts_at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of the files at the given paths only."""
    if not paths:
        return spark.createDataFrame([], "file_name string, path string, modified timestamp, content string")
    return _with_file(spark.read.text(paths, wholetext=True))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, piece, content)``: the lines of ``*.txt`` files, as pieces of one log for each file.

    Large files are split between tasks, so a file may be of any size; ``operators.pieces`` reads the lines of a file as a whole. A split
    lies in one task, whose row numbers ascend.
    """
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter=TRANSCRIPT_GLOB)
    piece = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_name").alias("file_name"), piece.alias("piece"), F.concat("value", F.lit("\n")).alias("content"))


def stream_transcripts(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same as a stream over the files that appear in the folder."""
    return _with_file(
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", TRANSCRIPT_GLOB)
        .text(path, wholetext=True)
    )


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')


def read_run_config(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run config with typed settings; rows without any value are dropped.

    ``position`` orders rows by file name, then by their place in the file; it is taken at the scan. Files are split between
    tasks, unless ``multi_line`` says that cells hold line breaks.
    Columns behind the settings (score columns of any number) stay text.
    """
    raw = _csv(spark, path, multi_line)
    filled = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`"), F.lit("")) != "" for c in raw.columns])
    typed = [
        F.col(c).try_cast(RUN_CONFIG_TYPES[c]).alias(c) if c in RUN_CONFIG_TYPES else F.col(f"`{c}`")
        for c in raw.columns
    ]
    # A split lies in one task, whose row numbers ascend.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select("*", place.alias("_place")).filter(filled).select(*typed, F.col("_place").alias("position"))


def read_ratings_wide(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Wide rating table as text; cells that mean "missing" are null."""
    raw = _csv(spark, path, multi_line)
    return raw.select(*[null_token(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_catalog(spark: SparkSession, path: str, key: str, kind: str | None = None) -> DataFrame:
    """``(kind, position, id, title, label, content)`` of a JSON object with one array ``key``."""
    schema = T.StructType([T.StructField(key, T.ArrayType(CATALOG_ITEM))])
    return spark.read.schema(schema).json(path, multiLine=True).select(
        F.lit(kind or key).alias("kind"), F.posexplode(key).alias("position", "item")
    ).select("kind", "position", "item.*")


def read_scored_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(SCORED_DIALOGUE)
        .json(path, multiLine=True, pathGlobFilter="*.json")
        .select(F.col("_metadata.file_name").alias("file_name"), "metadata", "pairs")
    )


def read_chat_corpus(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Chat examples: a JSON array per file, or JSON lines as written by ``write_chat_corpus``."""
    return spark.read.schema(CHAT_EXAMPLE).json(path, multiLine=not json_lines)


def read_device_log(spark: SparkSession, path: str) -> DataFrame:
    """Training history JSON with nested device readings."""
    return spark.read.schema(DEVICE_LOG).json(path, multiLine=True)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file_name, path, modified)`` without reading contents."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(F.col("_metadata.file_name").alias("file_name"), "path", F.col("modificationTime").alias("modified"))
    )
