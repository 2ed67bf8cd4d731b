"""File and artifact names as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "base"
STAMP = "yyyyMMdd_HHmmss"


def turns_from_name(name: Column) -> Column:
    """Turn count at the end of ``dialogue_<keyword>_<stamp>_<turns>.txt``, null if unreadable."""
    last = F.split_part(name, F.lit("_"), F.lit(-1))
    return F.split_part(last, F.lit("."), F.lit(1)).try_cast("int")


def keyword_from_name(name: Column) -> Column:
    """Keyword of ``dialogue_<keyword>_<stamp>_<turns>.txt``, null for other names."""
    return F.nullif(F.regexp_extract(name, r"^dialogue_(.*)_[0-9]{8}_[0-9]{6}_[^_]*\.txt$", 1), F.lit(""))


def artifact_ids(path: Column, default_checkpoint: str = BASE) -> Column:
    """``struct(model_version, checkpoint)`` of a model path.

    The rating table calls the untuned checkpoint ``base``; pass ``default_checkpoint="default"``
    for the spelling used inside dialogue file names.
    """
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: (p != "") & (p != "."))
    at = F.array_position(parts, F.lit("models")).cast("int")
    found = at > 0
    checkpoint = F.get(F.filter(parts, lambda p: p.startswith("checkpoint-")), F.lit(0))
    return F.struct(
        F.coalesce(F.when(found, F.get(parts, at)), F.lit(BASE)).alias("model_version"),
        F.coalesce(F.when(found, checkpoint), F.lit(default_checkpoint)).alias("checkpoint"),
    )


def checkpoint_number(checkpoint: Column) -> Column:
    """``checkpoint-300`` is 300, ``base`` is 0, anything else null."""
    number = F.nullif(F.regexp_extract(checkpoint, r"^checkpoint-([0-9]+)$", 1), F.lit(""))
    return F.when(checkpoint == BASE, F.lit(0)).otherwise(number.try_cast("int"))


def dialogue_file_name(model: Column, checkpoint: Column, question: Column, ts: Column) -> Column:
    return F.concat(
        F.lit("dialogue_"),
        F.coalesce(model, F.lit(BASE)),
        F.lit("_"),
        F.coalesce(checkpoint, F.lit("default")),
        F.lit("_"),
        question.cast("string"),
        F.lit("_"),
        F.date_format(ts, STAMP),
        F.lit(".json"),
    )


def transcript_file_name(keyword: Column, ts: Column, turns: Column) -> Column:
    return F.concat(
        F.lit("dialogue_"), keyword, F.lit("_"), F.date_format(ts, STAMP), F.lit("_"), turns.cast("string"), F.lit(".txt")
    )
