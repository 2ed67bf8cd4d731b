"""Quality rules: a table of thresholds compiled into one Spark projection.

Counts and ratios of a whole text come from built-in functions only. ``RULES`` names a measure with its
least and largest allowed value; a text is kept if no base rule fails and every measure lies within.

Nulls: a null text has no words and fails. Empty texts fail. Repeated rows are judged each. The work on
a text grows as its words times the logarithm of their number. An empty table gives an empty table.
All input columns are carried inside one struct, so their names cannot clash with the measures.
Equal three-word windows are told by a 64-bit hash within one text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.plan import let, with_computed
from colloquy.llm.words import SPACES

SPACE_CHARACTERS = " \t\n\x0b\x0c\r"

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was as be with by this from are or an at not have "
    "der die und das den von zu mit ist im für auf ein eine nicht sich des dem auch es "
    "le la les de et un une du des en que pour dans est au par sur pas ce il "
    "el los las y en un una por con para se del al lo como más o su es que"
).split()

STOP_FORMS = sorted({*STOP_WORDS, *(word.capitalize() for word in STOP_WORDS)})


class Rule(NamedTuple):
    measure: str
    least: float
    most: float


#: The method's verdict. The measures are defined in ``measures``.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbols_per_word", 0.0, 0.3),
    Rule("stop_word_share", 0.01, 1.0),
    Rule("dup_line_share", 0.0, 0.5),
    Rule("ellipsis_line_share", 0.0, 0.5),
)
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def _count_less(text: Column, characters: str) -> Column:
    less = F.length(text) - F.length(F.translate(text, characters, ""))
    return F.when(text.rlike("[" + characters + "]"), less).otherwise(F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All input columns in the struct ``row``, and the counts of each whole text."""
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = F.col("_text")
    trimmed = F.btrim(whole, F.lit(SPACE_CHARACTERS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARACTERS)) != "")
    out = with_computed(docs, _words=words, _lines=lines)
    last = F.size("_words") - 3
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    stop = F.filter("_words", lambda w: w.isin(STOP_FORMS))
    ellipses = F.filter("_lines", lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))
    out = with_computed(
        out.select(
            "row",
            F.size("_words").cast("bigint").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
            _count_less(F.col("_text"), SYMBOLS).cast("bigint").alias("n_symbols"),
            F.size("_lines").cast("bigint").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            F.size(stop).cast("bigint").alias("n_stop_words"),
            F.size(ellipses).cast("bigint").alias("n_ellipsis_lines"),
            windows.alias("_windows"),
        ),
        _hashes=F.col("_windows"),
    ).drop("_windows")
    # Starts of windows that have an equal one: neighbours of the same hash after sorting.
    starts = let(
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        s,
                        lambda x, i: F.struct(
                            ((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])).alias("twice"),
                            x["i"].alias("i"),
                        ),
                    ),
                    lambda x: F.coalesce(x["twice"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    none = F.array().cast("array<int>")
    out = with_computed(
        out, _starts=F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), starts).otherwise(none)
    )
    gaps = F.transform("_starts", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - at, F.lit(3))))
    repeated = F.aggregate(gaps, F.lit(0), lambda total, n: total + n).cast("bigint")
    return out.select(*[c for c in out.columns if not c.startswith("_")], repeated.alias("n_repeat_words"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``measures`` with the ratios, ``base_failed`` and ``kept``."""

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    out = measures(docs, text).withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbols_per_word": ratio("n_symbols", "n_words"),
            "stop_word_share": ratio("n_stop_words", "n_words"),
            "dup_line_share": ratio("n_dup_lines", "n_lines"),
            "ellipsis_line_share": ratio("n_ellipsis_lines", "n_lines"),
            "base_failed": (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        }
    )
    within = ~F.col("base_failed")
    for rule in rules:
        within = within & F.col(rule.measure).between(rule.least, rule.most)
    return out.withColumn("kept", within)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return judged(docs, rules, text).filter("kept").select("row.*")
