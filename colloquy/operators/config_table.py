"""Operators on the run-config table and on file listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.names import checkpoint_number, keyword_from_name, turns_from_name
from colloquy.functions.text import is_blank


def flag_duplicates(rows: DataFrame, *keys: str, out: str = "is_duplicate") -> DataFrame:
    """Mark every member of a duplicate key group; null keys equal each other.

    Group sizes come from a partial aggregation and only the repeated keys are joined back, so the
    rows of a hot key never meet in one window; adaptive execution splits it in the join.
    """
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    marked = rows.join(
        repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias(out)),
        reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]),
        "left",
    )
    return marked.drop(*[f"_k{i}" for i in range(len(keys))]).withColumn(out, F.coalesce(out, F.lit(False)))


def drop_duplicates_keep_first(rows: DataFrame, *keys: str, position: str) -> DataFrame:
    """Per key the row that comes first by ``position``, which tells rows apart; null keys equal each other.

    The first positions are a hash aggregation over keys alone; the rows themselves are not shuffled by key but
    matched by position, so a hot key is no hot partition.
    """
    first = rows.groupBy(*keys).agg(F.min(position).alias(position)).select(position)
    return rows.join(first, position, "left_semi").select(*rows.columns)


def check_catalog_ids(config: DataFrame, catalog: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, unknown)`` config rows by whether the catalog knows their id."""
    ids = catalog.select(F.col("id").alias(id_column)).distinct()
    return config.join(ids, id_column, "left_semi"), config.join(ids, id_column, "left_anti")


def pending_rows(config: DataFrame, column: str = "dialogue") -> DataFrame:
    """Rows whose dialogue cell is null or blank."""
    return config.filter(is_blank(F.col(column)))


def record_outputs(config: DataFrame, produced: DataFrame, keys: Sequence[str], column: str = "dialogue") -> DataFrame:
    """Fill ``column`` of matching rows; null keys match each other, so base rows are recorded too.

    ``produced`` has at most one row per key; of several the greatest file name is taken.
    """
    latest = produced.groupBy(*keys).agg(F.max(column).alias("_new"))
    renamed = latest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_new")
    matched = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return config.join(renamed, matched, "left").select(
        *[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in config.columns]
    )


def latest_checkpoint(listing: DataFrame, *keys: str, name: str = "name") -> DataFrame:
    """Checkpoint folder with the highest number."""
    return (
        listing.withColumn("_number", checkpoint_number(F.col(name)))
        .filter(F.col(name).startswith("checkpoint-") & F.col("_number").isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(name, "_number").alias(name))
    )


def latest_file(files: DataFrame, name: str = "file_name", modified: str = "modified") -> DataFrame:
    """Newest transcript per keyword and turn count, both read from its name; the greater name wins a tie."""
    keyed = files.withColumn("keyword", keyword_from_name(F.col(name))).withColumn("turns", turns_from_name(F.col(name)))
    newest = F.max(F.struct(modified, name)).getField(name)
    return keyed.filter("keyword is not null and turns is not null").groupBy("keyword", "turns").agg(newest.alias(name))
