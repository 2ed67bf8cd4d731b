"""A rating store in buckets, with a manifest as commit point.

Ratings lie in ``BUCKETS`` folders by a hash of their dialogue, each key once. A load reads and rewrites only the buckets it
touches, into new folders, and then writes one small manifest file that says which folder each bucket has. That file is the
commit: it appears as a whole or not at all, so a load that fails before it leaves the old version, and readers never see
half a load. Reading folds nothing: it opens one folder for each bucket.

A load carries the name of its writer and a number. A load that a manifest already names is not applied again, so a restarted stream or
a repeated job changes nothing. Two writers at a time: the later one finds its version taken and raises; it may be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ratings import RATING_KEYS, upsert_ratings

BUCKETS = 64

_MANIFEST = "bucket int, folder string, writer string, load bigint, version bigint"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class RatingStore:
    """``(keys, score)`` below a path that all executors reach; ``keys[0]`` picks the bucket."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str] = RATING_KEYS, value: str = "score", buckets: int = BUCKETS
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.value = value
        self.buckets = buckets

    def manifest(self) -> list:
        """Rows of all committed versions: a bucket's folder since that version. Their number is that of the buckets loads have touched."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _folders(self, committed: list) -> dict[int, str]:
        return {r["bucket"]: r["folder"] for r in sorted(committed, key=lambda r: r["version"]) if r["bucket"] >= 0}

    def _rows(self, folders: dict[int, str], like: DataFrame | None = None) -> DataFrame | None:
        if not folders:
            return like.limit(0) if like is not None else None
        paths = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(*paths)

    def read(self) -> DataFrame:
        """The store as of its last commit."""
        rows = self._rows(self._folders(self.manifest()))
        if rows is None:
            raise ValueError(f"no load has been committed to {self.path}")
        return rows

    def load(self, ratings: DataFrame, writer: str, number: int) -> bool:
        """Merge one load into the store: a new score replaces the old one, a null new score leaves it.

        False if this load was there already. ``ratings`` holds one score for each key.
        """
        committed = self.manifest()
        if any(r["writer"] == writer and r["load"] == number for r in committed):
            return False
        folders = self._folders(committed)
        new = ratings.select(*self.keys, self.value).withColumn("bucket", _bucket(self.keys[0], self.buckets))
        folder = f"load-{uuid.uuid4().hex}"
        # At most ``buckets`` numbers come to the driver.
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        old = self._rows({b: f for b, f in folders.items() if b in touched}, new.drop("bucket"))
        merged = upsert_ratings(old, new.drop("bucket"), self.keys, self.value)
        merged = merged.withColumn("bucket", _bucket(self.keys[0], self.buckets))
        # Rows of a bucket come together for few files; adaptive execution splits a bucket that is too large for a task.
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._commit(committed, [(b, folder, writer, number) for b in sorted(touched)] or [(-1, folder, writer, number)])
        return True

    def _commit(self, committed: list, entries: list[tuple]) -> None:
        version = max((r["version"] for r in committed), default=0) + 1
        rows = self.spark.createDataFrame([(*entry, version) for entry in entries], _MANIFEST)
        rows.drop("version").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")
