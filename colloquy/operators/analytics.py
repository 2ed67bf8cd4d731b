"""Rating analytics over the long rating table.

``ratings(dialogue_id, model_version, checkpoint, metric_type, pair_num, score)``. Every operator
is a partial aggregation over it, so no key has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.names import BASE, checkpoint_number, turns_from_name
from colloquy.functions.scores import coerce_score, null_token, pair_penalty
from colloquy.functions.text import is_blank
from colloquy.schemas import METRICS
from colloquy.session import stored

# Share of each metric in the 85 % that the metric means carry, and the consistency share.
METRIC_WEIGHTS = {"tone": 0.35 / 0.85, "logic": 0.20 / 0.85, "approach": 0.20 / 0.85, "format": 0.10 / 0.85}
MEAN_SHARE = 0.85
CONSISTENCY_SHARE = 0.15
SCORES = (0, 1, 2, 3, 4)
LOW_RATED = 2
FIRST_CHECKPOINT = "checkpoint-100"
LAST_CHECKPOINT = "checkpoint-990"

MODEL = "model_version"
CHECKPOINT = "checkpoint"


def fill_default_keys(ratings: DataFrame) -> DataFrame:
    return ratings.na.fill(BASE, [MODEL, CHECKPOINT])


def melt_ratings(wide: DataFrame, ids: Sequence[str], rule: str = "numeric", part_width: int | None = None) -> DataFrame:
    """Long ratings of a wide table; rows with any null (also in ``ids``) are dropped.

    A metric column is one whose name contains a metric name. For the table of ``ratings_in_parts`` give its width:
    pairs then get the numbers they had, and ``part`` goes.
    """
    if part_width is not None:
        flat = melt_ratings(wide, [*ids, "part"], rule)
        number = F.col("part").cast("int") * part_width + F.col("pair_num")
        named = F.concat("metric_type", F.lit("_pair"), number.cast("string"))
        return flat.withColumns({"pair_num": number, "metric_pair": named}).drop("part")
    ids = list(ids)
    metric_columns = [c for c in wide.columns if c not in ids and any(m in c for m in METRICS)]
    if not metric_columns:
        raise ValueError("no metric columns")
    text = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in metric_columns])
    named = F.regexp_extract("metric_pair", r"(\w+)_pair(\d+)", 1)
    number = F.regexp_extract("metric_pair", r"(\w+)_pair(\d+)", 2)
    return (
        text.unpivot(ids, metric_columns, "metric_pair", "score_text")
        .select(
            *ids,
            "metric_pair",
            F.nullif(named, F.lit("")).alias("metric_type"),
            number.try_cast("int").alias("pair_num"),
            coerce_score(null_token(F.col("score_text")), rule).alias("score"),
        )
        .na.drop()
    )


def summary_stats(ratings: DataFrame, *keys: str, digits: int | None = 3) -> DataFrame:
    """Mean, sample deviation, min, max and count; rounded half-even as the published table is."""
    keys = keys or (MODEL, CHECKPOINT, "metric_type")

    def rounded(c: Column) -> Column:
        return c if digits is None else F.bround(c, digits)

    return ratings.groupBy(*keys).agg(
        rounded(F.avg("score")).alias("mean"),
        rounded(F.stddev_samp("score")).alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        F.count("score").alias("count"),
    )


def _counted_rows(rows: DataFrame, dialogue: str) -> DataFrame:
    """Rows that enter the distribution: a filled name without a turn count excludes its row."""
    return rows.filter(is_blank(F.col(dialogue)) | turns_from_name(F.col(dialogue)).isNotNull())


def expected_pairs(config: DataFrame, dialogue: str = "dialogue") -> DataFrame:
    """One row: pairs to be rated according to the turn counts in the file names."""
    return config.agg(
        F.coalesce(F.sum(turns_from_name(F.col(dialogue))), F.lit(0)).cast("bigint").alias("expected")
    )


def score_distribution(
    scores: DataFrame,
    config: DataFrame,
    *,
    metrics: Sequence[str] = ("tone", "logic"),
    dialogue: str = "dialogue",
    text: str = "score_text",
) -> DataFrame:
    """Per metric and score 0..4: count, share of valid scores, share of expected pairs.

    Scores outside the scale enter the denominator only; an empty denominator gives 0.
    """
    valid = coerce_score(F.col(text), "digits_raw")
    totals = (
        _counted_rows(scores, dialogue)
        .withColumn("_score", valid)
        .agg(
            *[
                F.struct(
                    F.lit(m).alias("metric_type"),
                    F.count(F.when(F.col("metric_type") == m, F.col("_score"))).alias("n_valid"),
                    F.array(
                        *[
                            F.struct(
                                F.lit(s).alias("score"),
                                F.count(F.when((F.col("metric_type") == m) & (F.col("_score") == s), 1)).alias("n"),
                            )
                            for s in SCORES
                        ]
                    ).alias("counts"),
                ).alias(m)
                for m in metrics
            ]
        )
        .select(F.inline(F.array(*metrics)))
        .select("metric_type", "n_valid", F.inline("counts"))
    )

    def percent(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))

    return totals.withColumn("_expected", expected_pairs(config, dialogue).scalar()).select(
        "metric_type",
        "score",
        "n",
        percent(F.col("n"), F.col("n_valid")).alias("pct_valid"),
        percent(F.col("n"), F.col("_expected")).alias("pct_expected"),
    )


def expected_and_missing(
    scores: DataFrame,
    config: DataFrame,
    *,
    metrics: Sequence[str] = ("tone", "logic"),
    dialogue: str = "dialogue",
    text: str = "score_text",
) -> DataFrame:
    """Per metric the expected, valid and missing numbers of scores; share null if nothing is expected."""
    valid = coerce_score(F.col(text), "digits_raw")
    totals = (
        _counted_rows(scores, dialogue)
        .agg(
            *[
                F.struct(
                    F.lit(m).alias("metric_type"),
                    F.count(F.when(F.col("metric_type") == m, valid)).alias("n_valid"),
                ).alias(m)
                for m in metrics
            ]
        )
        .select(F.inline(F.array(*metrics)))
    )
    missing = F.col("expected") - F.col("n_valid")
    return totals.withColumn("expected", expected_pairs(config, dialogue).scalar()).select(
        "metric_type",
        "expected",
        "n_valid",
        missing.alias("n_missing"),
        F.when(F.col("expected") != 0, missing / F.col("expected") * 100).alias("pct_missing"),
    )


def dialogue_average(
    scores: DataFrame, key: str = "dialogue", *, metrics: Sequence[str] = ("tone", "logic"), text: str = "score_text"
) -> DataFrame:
    """Mean and number of the valid scores of each dialogue that has a name."""
    valid = F.when(F.col("metric_type").isin(*metrics), coerce_score(F.col(text), "digits"))
    return scores.filter(F.col(key) != "").groupBy(key).agg(F.avg(valid).alias("avg_score"), F.count(valid).alias("n_scores"))


def low_rated_verdict(averages: DataFrame, files: DataFrame, key: str = "dialogue", limit: float = LOW_RATED) -> DataFrame:
    """``low``, ``ok`` or ``unrated`` for every dialogue whose file exists."""
    verdict = (
        F.when(F.col("avg_score") <= limit, "low").when(F.col("avg_score").isNotNull(), "ok").otherwise("unrated")
    )
    return averages.join(files.select(key).distinct(), key, "left_semi").withColumn("verdict", verdict)


def incomplete_dialogues(averages: DataFrame, key: str = "dialogue") -> DataFrame:
    """Rated dialogues with fewer scored pairs than the turn count in their file name."""
    return (
        averages.withColumn("expected_pairs", turns_from_name(F.col(key)))
        .withColumn("scored_pairs", F.floor(F.col("n_scores") / 2))
        .filter("n_scores > 0 and scored_pairs < expected_pairs")
    )


def pair_means(ratings: DataFrame, *keys: str) -> DataFrame:
    """Mean per group over all pairs, over pair 1 and over pair 2."""
    return ratings.groupBy(*keys).agg(
        F.avg("score").alias("mean"),
        F.avg(F.when(F.col("pair_num") == 1, F.col("score"))).alias("mean1"),
        F.avg(F.when(F.col("pair_num") == 2, F.col("score"))).alias("mean2"),
    )


def checkpoint_score(ratings: DataFrame, order: str = "dialogue_id", strict: bool = False) -> DataFrame:
    """Weighted score per model and checkpoint, with ``first_seen`` for ties.

    85 % weighted metric means and 15 % mean pair penalty over the metrics that have both pairs.
    Where a metric is missing the score is null; ``strict`` raises instead.
    """
    return _score_of_cells(checkpoint_cells(ratings, order), strict)


def checkpoint_cells(ratings: DataFrame, order: str = "dialogue_id") -> DataFrame:
    """Sum, count, means over all pairs, pair 1 and pair 2, and the first row, of each model, checkpoint and metric."""
    return ratings.groupBy(MODEL, CHECKPOINT, "metric_type").agg(
        F.sum("score").alias("total"),
        F.count("score").alias("n"),
        F.avg("score").alias("mean"),
        F.avg(F.when(F.col("pair_num") == 1, F.col("score"))).alias("mean1"),
        F.avg(F.when(F.col("pair_num") == 2, F.col("score"))).alias("mean2"),
        F.min(order).alias("first_seen"),
    )


def _score_of_cells(seen: DataFrame, strict: bool = False) -> DataFrame:
    def of(metric: str, value: Column) -> Column:
        return F.max(F.when(F.col("metric_type") == metric, value))

    weighted = sum((of(m, F.col("mean")) * w for m, w in METRIC_WEIGHTS.items()), F.lit(0.0))
    penalty = F.when(F.col("metric_type").isin(*METRIC_WEIGHTS), pair_penalty(F.col("mean1") - F.col("mean2")))
    consistency = F.coalesce(F.avg(penalty), F.lit(0.0))
    score = weighted * MEAN_SHARE + consistency * CONSISTENCY_SHARE
    if strict:
        score = F.when(score.isNull(), F.raise_error(F.lit("a checkpoint lacks a metric"))).otherwise(score)
    return seen.groupBy(MODEL, CHECKPOINT).agg(score.alias("final_score"), F.min("first_seen").alias("first_seen"))


def best_checkpoint(scored: DataFrame) -> DataFrame:
    """Checkpoint with the highest score of every tuned model; the first one met wins a tie."""
    rank = F.struct((-F.col("final_score")).alias("s"), F.col("first_seen"), F.col(CHECKPOINT))
    return (
        scored.filter((F.col(MODEL) != BASE) & F.col("final_score").isNotNull())
        .groupBy(MODEL)
        .agg(F.min_by(F.struct(CHECKPOINT, "final_score"), rank).alias("best"))
        .select(MODEL, "best.*")
    )


def best_checkpoint_rows(ratings: DataFrame, best: DataFrame) -> DataFrame:
    """All base ratings, and those of tuned models at their best checkpoint; ratings are read once."""
    chosen = best.select(MODEL, CHECKPOINT, F.lit(True).alias("_chosen"))
    marked = ratings.join(chosen, [MODEL, CHECKPOINT], "left")
    return marked.filter((F.col(MODEL) == BASE) | F.col("_chosen")).select(*ratings.columns)


def score_quartiles(ratings: DataFrame, *keys: str) -> DataFrame:
    """Exact five-number summary.

    Scores are first reduced to a count per distinct value; a rating scale has few, so the
    percentile works on a handful of rows per group however many ratings there are.
    """
    counted = ratings.groupBy(*keys, "score").agg(F.count("*").alias("_n"))
    quartiles = F.percentile("score", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]), F.col("_n"))
    return (
        counted.groupBy(*keys)
        .agg(quartiles.alias("_q"), F.sum("_n").alias("n"))
        .select(
            *keys,
            *[F.col("_q")[i].alias(name) for i, name in enumerate(("min", "q1", "median", "q3", "max"))],
            "n",
        )
    )


def checkpoint_progression(ratings: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metric means by model and checkpoint number, one column per metric."""
    return (
        ratings.withColumn("checkpoint_num", checkpoint_number(F.col(CHECKPOINT)))
        .filter("checkpoint_num is not null")
        .groupBy(MODEL, "checkpoint_num")
        .agg(*[F.avg(F.when(F.col("metric_type") == m, F.col("score"))).alias(m) for m in metrics])
    )


def model_metric_means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(MODEL, "metric_type").agg(F.avg("score").alias("mean"))


def _against_base(means: DataFrame, base: DataFrame) -> DataFrame:
    base = base.filter(F.col(MODEL) == BASE).select("metric_type", F.col("mean").alias("base_mean"))
    return (
        means.filter(F.col(MODEL) != BASE)
        .join(base, "metric_type", "left")
        .withColumn("improvement", F.col("mean") - F.col("base_mean"))
    )


def improvement_from_base_best(ratings: DataFrame, best: DataFrame) -> DataFrame:
    """Metric means at the best checkpoint against the base means."""
    means = model_metric_means(best_checkpoint_rows(ratings, best))
    return _against_base(means, means)


def best_against_base(ratings: DataFrame, order: str = "dialogue_id") -> DataFrame:
    """``improvement_from_base_best`` at the checkpoints with the best score, from one scan of the ratings.

    Everything follows from a row for each model, checkpoint and metric, which is stored.
    """
    cells = stored(checkpoint_cells(ratings, order), "checkpoint-cells")
    best = best_checkpoint(_score_of_cells(cells)).select(MODEL, CHECKPOINT, F.lit(True).alias("_chosen"))
    chosen = cells.join(best, [MODEL, CHECKPOINT], "left").filter((F.col(MODEL) == BASE) | F.col("_chosen"))
    means = chosen.groupBy(MODEL, "metric_type").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return _against_base(means, means)


def improvement_from_base_all(ratings: DataFrame) -> DataFrame:
    """Metric means over all checkpoints against the base means."""
    means = model_metric_means(ratings)
    return _against_base(means, means)


def pair_difference(ratings: DataFrame) -> DataFrame:
    """Mean of pair 1 minus mean of pair 2, where both exist."""
    return (
        pair_means(ratings, MODEL, CHECKPOINT, "metric_type")
        .filter("mean1 is not null and mean2 is not null")
        .select(MODEL, CHECKPOINT, "metric_type", (F.col("mean1") - F.col("mean2")).alias("difference"))
    )


def best_metric_per_model(ratings: DataFrame) -> DataFrame:
    """Metric with the highest mean; the first name wins a tie."""
    rank = F.struct((-F.col("mean")).alias("m"), F.col("metric_type"))
    return (
        model_metric_means(ratings)
        .groupBy(MODEL)
        .agg(F.min_by(F.struct("metric_type", "mean"), rank).alias("b"))
        .select(MODEL, "b.*")
    )


def stability(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(MODEL, "metric_type").agg(F.stddev_samp("score").alias("std"))


def first_to_last_gain(
    ratings: DataFrame, first: str | None = FIRST_CHECKPOINT, last: str | None = LAST_CHECKPOINT
) -> DataFrame:
    """Mean at the last checkpoint minus mean at the first.

    With ``None`` for both, every model is measured from its own first to its own last checkpoint.
    """
    means = ratings.groupBy(MODEL, "metric_type", CHECKPOINT).agg(F.avg("score").alias("_mean"))
    if first is None and last is None:
        number = checkpoint_number(F.col(CHECKPOINT))
        at_first, at_last = F.min_by("_mean", number), F.max_by("_mean", number)
    else:
        at_first = F.max(F.when(F.col(CHECKPOINT) == first, F.col("_mean")))
        at_last = F.max(F.when(F.col(CHECKPOINT) == last, F.col("_mean")))
    return means.groupBy(MODEL, "metric_type").agg(
        at_first.alias("first_mean"), at_last.alias("last_mean"), (at_last - at_first).alias("gain")
    )
