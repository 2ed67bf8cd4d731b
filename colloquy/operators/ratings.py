"""Judge answers to ratings, and the rating store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.plan import let
from colloquy.functions.scores import coerce_score
from colloquy.functions.text import is_blank, py_strip, stripped_lines
from colloquy.operators.transcripts import PAIR_OPEN
from colloquy.schemas import METRICS

# Labels of the judge answer formats.
TONE_LABEL = "口調："
LOGIC_LABEL = "論理性："
SCORE_LABEL = "スコア："
COMMENT_LABEL = "コメント："
COLON = "："
CATEGORY_LABELS = {
    "tone": "■ソクラテス的な口調",
    "approach": "■ソクラテス的な対話姿勢",
    "format": "■形式的正確性",
    "logic": "■対話の自然さ・論理性",
}

_PAIR_START = r"(?Umd)^(?=[\s\x1c-\x1f&&[^\n]]*【ペア)"
_CATEGORY_START = r"(?Umd)^(?=[\s\x1c-\x1f&&[^\n]]*(?:" + "|".join(CATEGORY_LABELS.values()) + "))"
_PAIR_NUMBER = r"^【ペア\s*([0-9０-９]+)"

RATING_KEYS = ("dialogue_id", "metric_type", "pair_num")


def _after_colon(line: Column) -> Column:
    """Text between the first and the second full-width colon."""
    return py_strip(F.get(F.split(line, COLON), F.lit(1)))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _pair_number(block_lines: Column, ordinal: Column) -> Column:
    named = F.regexp_extract(F.get(block_lines, F.lit(0)), _PAIR_NUMBER, 1)
    digits = F.translate(named, "０１２３４５６７８９", "0123456789")
    return F.coalesce(digits.try_cast("int"), ordinal.cast("int"))


def parse_two_metric(answers: DataFrame, *keys: str, text: str = "answer", compact: bool = False) -> DataFrame:
    """Long ``(keys, pair_num, metric_type, quantitative)`` of two-metric answers.

    A pair counts when it has both scores, and keeps the number its header states; of several blocks
    with one number the last counts. With
    ``compact=True`` complete pairs are numbered one after the other, so pairs behind an incomplete
    one move up, and scores in front of the first header count as a pair.
    """
    blocks = F.transform(F.split(py_strip(F.col(text)), _PAIR_START), stripped_lines)

    def scores(block: Column, i: Column) -> Column:
        scored = F.filter(block, lambda x: ~x.startswith(PAIR_OPEN))
        tone = F.filter(scored, lambda x: x.contains(TONE_LABEL))
        logic = F.filter(scored, lambda x: ~x.contains(TONE_LABEL) & x.contains(LOGIC_LABEL))
        return F.struct(
            F.coalesce(F.get(block, F.lit(0)).startswith(PAIR_OPEN), F.lit(False)).alias("opened"),
            _pair_number(block, i + 1).alias("pair_num"),
            _after_colon(_last(tone)).alias("tone"),
            _after_colon(_last(logic)).alias("logic"),
        )

    pairs = F.filter(
        F.transform(blocks, scores),
        lambda p: p["tone"].isNotNull() & p["logic"].isNotNull() & (F.lit(compact) | p["opened"]),
    )
    if not compact:

        def last_of_number(all_: Column) -> Column:
            numbers = F.transform(all_, lambda p: p["pair_num"])
            last = let(numbers, lambda n: F.transform(F.array_distinct(n), lambda x: F.size(n) - F.array_position(F.reverse(n), x)))
            return F.transform(F.sort_array(last), lambda i: F.get(all_, i.cast("int")))

        pairs = let(pairs, last_of_number)
    number = (F.col("_at") + 1) if compact else F.col("_p.pair_num")
    return answers.select(*keys, F.posexplode(pairs).alias("_at", "_p")).select(
        *keys,
        number.alias("pair_num"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric_type"), F.col(f"_p.{m}").alias("quantitative"))
                    for m in ("tone", "logic")
                ]
            )
        ),
    )


def _category(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for metric, label in CATEGORY_LABELS.items():
        out = F.when(line.startswith(label), F.lit(metric)).otherwise(out)
    return out


def parse_four_metric(answers: DataFrame, *keys: str, text: str = "answer") -> DataFrame:
    """Long ``(keys, pair_num, metric_type, quantitative, qualitative)`` of four-metric answers.

    Pairs are numbered in the order of their headers. A category stays in force until the next one,
    also across a pair header. Fields that the answer leaves out are empty strings.
    """
    def last_category(piece: Column) -> Column:
        named = F.filter(stripped_lines(piece), lambda x: _category(x).isNotNull())
        return let(_last(named), _category)

    # every piece of the answer with the category in force where it starts
    state = "struct<category:string,out:array<struct<piece:string,before:string>>>"
    carried = F.aggregate(
        F.split(F.col(text), _PAIR_START),
        F.struct(F.lit(None).cast("string").alias("category"), F.array().alias("out")).cast(state),
        lambda acc, piece: F.struct(
            F.coalesce(last_category(piece), acc["category"]).alias("category"),
            F.concat(
                acc["out"], F.array(F.struct(piece.alias("piece"), acc["category"].alias("before")))
            ).alias("out"),
        ).cast(state),
        lambda acc: acc["out"],
    )

    def sections(entry: Column) -> Column:
        return F.transform(
            F.split(entry["piece"], _CATEGORY_START),
            lambda s: F.struct(
                F.coalesce(let(py_strip(s), _category), entry["before"]).alias("category"), stripped_lines(s).alias("lines")
            ),
        )

    def field(parts: Column, metric: str, label: str) -> Column:
        own = F.flatten(
            F.transform(
                F.filter(parts, lambda s: s["category"] == metric),
                lambda s: F.filter(s["lines"], lambda x: x.startswith(label)),
            )
        )
        return F.coalesce(_after_colon(_last(own)), F.lit(""))

    headed = F.transform(F.filter(carried, lambda e: py_strip(e["piece"]).startswith(PAIR_OPEN)), sections)
    ratings = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_type"),
                field(F.col("_parts"), m, SCORE_LABEL).alias("quantitative"),
                field(F.col("_parts"), m, COMMENT_LABEL).alias("qualitative"),
            )
            for m in METRICS
        ]
    )
    return (
        answers.select(*keys, F.posexplode(headed).alias("_at", "_parts"))
        .select(*keys, (F.col("_at") + 1).alias("pair_num"), F.inline(ratings))
    )


def attach_ratings(pairs: Column, ratings: Column) -> Column:
    """Zip two arrays by position and cut to the shorter: ``array<struct<pair, rating>>``."""
    n = F.least(F.size(pairs), F.size(ratings))
    return F.transform(
        F.slice(pairs, 1, n), lambda p, i: F.struct(p.alias("pair"), F.get(ratings, i).alias("rating"))
    )


def join_ratings(pairs: DataFrame, ratings: DataFrame, *keys: str) -> DataFrame:
    """Long form of the same: every pair with its ratings, unrated pairs kept."""
    return pairs.join(ratings, list(keys), "left")


def long_ratings(parsed: DataFrame, rule: str = "float") -> DataFrame:
    """Numeric ratings of parsed answers; text that is no score is left out."""
    return parsed.withColumn("score", coerce_score(F.col("quantitative"), rule)).filter("score is not null")


def upsert_ratings(
    store: DataFrame, new: DataFrame, keys: Sequence[str] = RATING_KEYS, value: str = "score"
) -> DataFrame:
    """Store after a load: a new score replaces the old one, a null new score leaves it.

    One aggregation over the union. Partial aggregation leaves one row per key and task before the
    shuffle, and applying the same load twice changes nothing.
    """
    loaded = store.select(*keys, value, F.lit(0).alias("_load")).unionByName(
        new.select(*keys, value, F.lit(1).alias("_load"))
    )
    return latest_ratings(loaded, keys, value, "_load")


def latest_ratings(loads: DataFrame, keys: Sequence[str], value: str, load: str) -> DataFrame:
    """Per key the value of the latest load that has one; a load holds one value per key.

    ``max_by`` over plain columns keeps this a hash aggregation.
    """
    order = F.when(F.col(value).isNotNull(), F.col(load))
    return loads.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def unknown_files(new: DataFrame, config: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Rated dialogues that the config does not list."""
    return new.select(key).distinct().join(config.select(key).distinct(), key, "left_anti")


def ratings_wide(
    long: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS, pairs: Sequence[int] | None = None
) -> DataFrame:
    """Rows ``keys`` with a ``metric_pairN`` column for each of ``pairs``, by default 1 to the largest number there is."""
    if pairs is None:
        pairs = range(1, (long.agg(F.max("pair_num")).first()[0] or 0) + 1)
    names = [f"{m}_pair{n}" for n in pairs for m in metrics]
    metric_pair = F.concat("metric_type", F.lit("_pair"), F.col("pair_num").cast("string"))
    return long.withColumn("metric_pair", metric_pair).groupBy(*keys).pivot("metric_pair", names).agg(F.max("score"))


def ratings_in_parts(
    long: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS, width: int = 2
) -> DataFrame:
    """Rows ``(keys, part)`` with columns for ``width`` pairs; pair n is column ``(n - 1) % width + 1`` of its part.

    For tables whose width must not follow the longest dialogue. ``melt_ratings`` restores the numbers.
    """
    number = F.col("pair_num") - 1
    parts = long.withColumn("part", F.floor(number / width).cast("bigint")).withColumn("pair_num", number % width + 1)
    return ratings_wide(parts, [*keys, "part"], metrics, range(1, width + 1))


def is_fully_rated(pairs: Column, metrics: Sequence[str] = METRICS) -> Column:
    """Every pair has a score text for every metric; true for a dialogue without pairs."""
    return F.forall(
        pairs,
        lambda p: F.coalesce(
            F.forall(
                F.array(*[p["evaluation"][m]["quantitative"] for m in metrics]),
                lambda q: F.coalesce(q, F.lit("")) != "",
            ),
            F.lit(False),
        ),
    )


def unrated_files(files: DataFrame, store: DataFrame, key: str = "file_name", value: str = "score") -> DataFrame:
    """Files without any non-blank score."""
    rated = store.filter(~is_blank(F.col(value).cast("string"))).select(key).distinct()
    return files.join(rated, key, "left_anti")
