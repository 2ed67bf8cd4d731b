"""The flows end to end, composed from operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import analytics as A
from colloquy.operators import config_table as C
from colloquy.operators import examples as E
from colloquy.operators import prompts as P
from colloquy.operators import ratings as R
from colloquy.operators import transcripts as X

# The setting that selects an entry of each prompt catalog.
CATALOG_IDS = {
    "question": "INITIAL_QUESTION_ID",
    "user_prompt": "USER_PROMPT_ID",
    "persona": "PERSONA_ID",
    "others": "OTHERS_ID",
    "transform": "TRANSFORM_ID",
    "assistant_prompt": "ASSISTANT_PROMPT_ID",
    "response": "RESPONSE_ID",
    "update": "UPDATE_ID",
}


def dialogue_requests(config: DataFrame, catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """Pending run-config rows with both system prompts filled in; the models run elsewhere."""
    lookups = {kind: (catalogs[kind], id_column) for kind, id_column in CATALOG_IDS.items()}
    resolved = P.resolve_catalog(C.pending_rows(config), lookups)

    def filled(template: str, placeholders: Sequence[str]):
        def source(name: str) -> str:
            return "question" if name == "INITIAL_QUESTION" else name.lower()

        values = [(name, F.col(f"{source(name)}_content")) for name in placeholders]
        return P.fill_template(F.col(f"{template}_content"), values, required=[F.col("question_content")])

    return resolved.select(
        *config.columns,
        filled("user_prompt", P.USER_PLACEHOLDERS).alias("user_system_prompt"),
        filled("assistant_prompt", P.ASSISTANT_PLACEHOLDERS).alias("assistant_system_prompt"),
    )


def embedded_answers(transcripts: DataFrame, key: str = "file_name") -> DataFrame:
    """Answers that transcripts already carry in front of their log."""
    content = F.col("content")
    return transcripts.filter(X.is_evaluated(content)).select(key, X.embedded_evaluation(content).alias("answer"))


def judge_requests(
    transcripts: DataFrame,
    store: DataFrame,
    rubric: str,
    answer_fields: Sequence[str],
    key: str = "file_name",
) -> DataFrame:
    """One judge request per transcript that has neither stored ratings nor an answer in front of its log."""
    open_files = R.unrated_files(transcripts.filter(~X.is_evaluated(F.col("content"))), store, key)
    paired = X.with_pairs(open_files)
    request = P.build_judge_request(F.col("pairs"), F.lit(rubric), answer_fields)
    return paired.select(*[c for c in transcripts.columns if c != "content"], request.alias("request"))


def rate_answers(
    store: DataFrame, answers: DataFrame, config: DataFrame | None = None, key: str = "dialogue_id"
) -> DataFrame:
    """Rating store after a batch of two-metric answers.

    An answer replaces all ratings of its dialogue, so pairs that it lacks do not keep old scores. Answers
    for dialogues that ``config`` does not list change nothing; ``unknown_files`` reports them.
    """
    if config is not None:
        answers = answers.join(config.select(key).distinct(), key, "left_semi")
    kept = store.join(answers.select(key).distinct(), key, "left_anti")
    return kept.unionByName(R.long_ratings(R.parse_two_metric(answers, key)).select(*kept.columns))


def prepare_examples(
    transcripts: DataFrame, source: str = "file_name", *, prefix: str = "", windows=E.WINDOWS, max_tokens: int = E.MAX_TOKENS, tokenizer=None
) -> DataFrame:
    """Transcripts to classified chat examples; one pass without a shuffle."""
    windowed = E.extract_windows(X.with_turns(transcripts), source, windows=windows)
    return E.classify_examples(E.to_chat(windowed, source, prefix), max_tokens, tokenizer)


def rating_verdicts(scores: DataFrame, files: DataFrame, key: str = "dialogue") -> DataFrame:
    """Scores to a verdict per dialogue, ready for ``route_low_rated``."""
    return A.low_rated_verdict(A.dialogue_average(scores, key), files, key)


@dataclass
class Findings:
    """Tables of the rating report."""

    summary: DataFrame
    scores: DataFrame
    best: DataFrame
    quartiles: DataFrame
    progression: DataFrame
    gain_over_base: DataFrame
    pair_difference: DataFrame
    means: DataFrame
    best_metric: DataFrame
    stability: DataFrame
    first_to_last: DataFrame


def rating_findings(ratings: DataFrame, order: str = "dialogue_id") -> Findings:
    """All report tables. ``ratings`` is read by each of them, so it is kept, spilling to disk."""
    ratings = ratings.persist(StorageLevel.MEMORY_AND_DISK)
    scored = A.checkpoint_score(ratings, order)
    best = A.best_checkpoint(scored)
    return Findings(
        summary=A.summary_stats(ratings),
        scores=scored,
        best=best,
        quartiles=A.score_quartiles(A.best_checkpoint_rows(ratings, best), A.MODEL, "metric_type"),
        progression=A.checkpoint_progression(ratings),
        gain_over_base=A.improvement_from_base_best(ratings, best),
        pair_difference=A.pair_difference(ratings),
        means=A.model_metric_means(ratings),
        best_metric=A.best_metric_per_model(ratings),
        stability=A.stability(ratings),
        first_to_last=A.first_to_last_gain(ratings),
    )
