"""The score rules: how rating text becomes a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import py_strip

FULL_WIDTH_DIGITS = "０１２３４５６７８９"
DIGITS = "0123456789"
FLOAT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

# Text that reads as a missing cell in a rating table.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH_DIGITS, DIGITS)


def _gated(text: Column, pattern: str) -> Column:
    # Spark's cast accepts more than the rules do ("3d"), so the pattern decides first.
    return F.when(text.rlike(pattern), text.try_cast("double"))


def coerce_score(text: Column, rule: str = "numeric") -> Column:
    """Rating text as double, null when the rule does not accept it.

    ``float``   surrounding space and full-width digits allowed (rating upserts)
    ``digits``  digits only, after stripping (dialogue averages)
    ``digits_raw``  digits only, unstripped (score distribution)
    ``numeric`` ASCII numbers, surrounding space allowed (rating analytics)
    """
    if rule == "float":
        return _gated(_ascii_digits(py_strip(text)), FLOAT)
    if rule == "digits":
        return _gated(_ascii_digits(py_strip(text)), "^[0-9]+$")
    if rule == "digits_raw":
        return _gated(_ascii_digits(text), r"\A[0-9]+\z")
    if rule == "numeric":
        return _gated(py_strip(text), FLOAT)
    raise ValueError(f"unknown score rule {rule!r}")


def null_token(text: Column) -> Column:
    """Null for cells that mean "missing", the text otherwise."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def pair_penalty(diff: Column) -> Column:
    """Falling from pair 1 to pair 2 costs twice what rising earns."""
    return F.when(diff > 0, diff * F.lit(-0.2)).when(diff < 0, -diff * F.lit(0.1)).when(diff == 0, F.lit(0.0))
