"""A manifest of files: which are new, changed or gone since the last run, so that a run opens only those.

A manifest is a table ``(path, file_name, size, modified, hash)``. Listing a folder opens no file. A file whose size and time are those
of the manifest is the same. The others are opened once for a hash of their content: a file that was only touched is the
same as well. A manifest is saved as a new version when a run has done its work, so a run that fails starts again from the old
one. Spark's own listing has every path on the driver, so paths of changed files may be there too.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.readers import TRANSCRIPT_GLOB, read_transcripts_at

ENTRY = "path string, file_name string, size bigint, modified timestamp, hash string"
NEW, CHANGED, GONE, SAME = "new", "changed", "gone", "same"


def listing(spark: SparkSession, folder: str, glob: str = TRANSCRIPT_GLOB) -> DataFrame:
    """``(path, file_name, size, modified)`` of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def content_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, hash)`` of the files at these paths."""
    if not paths:
        return spark.createDataFrame([], "path string, hash string")
    files = spark.read.format("binaryFile").load([literal(path) for path in paths])
    return files.select("path", F.sha2("content", 256).alias("hash"))


def literal(path: str) -> str:
    """A path that Spark does not take as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


class FileManifest:
    """Versions of a manifest below a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _version(self) -> int:
        try:
            versions = self.spark.read.schema(f"{ENTRY}, version bigint").parquet(f"{self.path}/*/").select(F.col("_metadata.file_path").alias("f"))
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise
        found = versions.agg(F.max(F.regexp_extract("f", r"/v=(\d+)/", 1).cast("bigint")).alias("v")).first()["v"]
        return found or 0

    def entries(self) -> DataFrame:
        """The last version that was saved; no rows before the first."""
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/v={version}").filter("path is not null")

    def changes(self, folder: str, glob: str = TRANSCRIPT_GLOB) -> DataFrame:
        """All files of the folder and of the manifest, with ``status``: new, changed, gone or same."""
        old = self.entries().select("path", *[F.col(c).alias(f"_{c}") for c in ("file_name", "size", "modified", "hash")])
        both = listing(self.spark, folder, glob).join(old, "path", "full")
        seen = both.filter("size is not null and not (size <=> _size and modified <=> _modified)").select("path")
        hashes = content_hashes(self.spark, [r["path"] for r in seen.collect()]).withColumnRenamed("hash", "_new")
        status = (
            F.when(F.col("size").isNull(), GONE)
            .when(F.col("_size").isNull(), NEW)
            .when(F.coalesce("_new", "_hash") == F.col("_hash"), SAME)
            .otherwise(CHANGED)
        )
        return both.join(hashes, "path", "left").select(
            "path",
            F.coalesce("file_name", "_file_name").alias("file_name"),
            F.coalesce("size", "_size").alias("size"),
            F.coalesce("modified", "_modified").alias("modified"),
            F.coalesce("_new", "_hash").alias("hash"),
            status.alias("status"),
        )

    def save(self, changes: DataFrame) -> None:
        """A new version with the files that there are; one row without a path keeps an empty version readable."""
        names = [field.split()[0] for field in ENTRY.split(", ")]
        rows = changes.filter(F.col("status") != GONE).select(*names)
        mark = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        rows.unionByName(mark).write.mode("error").parquet(f"{self.path}/v={self._version() + 1}")

    def changed_transcripts(self, changes: DataFrame) -> DataFrame:
        """``(file_name, path, modified, content)`` of new and changed files; no other file is opened."""
        paths = [r["path"] for r in changes.filter(F.col("status").isin(NEW, CHANGED)).select("path").collect()]
        return read_transcripts_at(self.spark, [literal(path) for path in paths])
