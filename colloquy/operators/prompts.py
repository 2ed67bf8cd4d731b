"""Prompt and context assembly: request tables for models that run elsewhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import py_strip, token_count
from colloquy.operators import spans
from colloquy.operators.examples import TURN_CLOSE, TURN_OPEN
from colloquy.operators.transcripts import PAIR_CLOSE, PAIR_OPEN, format_pairs

# Placeholders in order of replacement, and the text of a failed completion.
USER_PLACEHOLDERS = ("INITIAL_QUESTION", "PERSONA", "OTHERS", "TRANSFORM")
ASSISTANT_PLACEHOLDERS = ("INITIAL_QUESTION", "RESPONSE", "UPDATE")
FAILED_COMPLETION = "Failed to respond"
CONTEXT_LIMIT = 8192
FIFO_MESSAGES = 5


def first_by_id(catalog: DataFrame, position: str = "position") -> DataFrame:
    """One row per id, the first in catalog order."""
    rest = [c for c in catalog.columns if c not in ("id", position)]
    return catalog.groupBy("id").agg(F.min_by(F.struct(*rest), position).alias("item")).select("id", "item.*")


def resolve_catalog(
    config: DataFrame, catalogs: Mapping[str, tuple[DataFrame, str]], position: str = "position"
) -> DataFrame:
    """Look up each catalog by id: adds ``<name>_label``, ``<name>_content`` and ``<name>_found``.

    ``catalogs`` maps a name to (catalog, id column of config). The joins carry no broadcast hint:
    Spark broadcasts a catalog whose measured size is under its threshold and otherwise runs a
    shuffled join in which adaptive execution splits a hot id.
    """
    out = config
    for name, (catalog, id_column) in catalogs.items():
        items = first_by_id(catalog, position)
        label = next((c for c in ("label", "title") if c in items.columns), None)
        looked_up = items.select(
            F.col("id").alias(f"_{name}_id"),
            (F.col(label) if label else F.lit(None).cast("string")).alias(f"{name}_label"),
            F.col("content").alias(f"{name}_content"),
            F.lit(True).alias(f"{name}_found"),
        )
        out = (
            out.join(looked_up, F.col(id_column) == F.col(f"_{name}_id"), "left")
            .drop(f"_{name}_id")
            .withColumn(f"{name}_found", F.coalesce(f"{name}_found", F.lit(False)))
        )
    return out


def placeholder(name: str) -> str:
    return "{{" + name + "}}"


def fill_template(template: Column, values: Sequence[tuple[str, Column]], required: Sequence[Column] = ()) -> Column:
    """Replace placeholders one after the other; later ones also see earlier inserted text.

    A null template or a null in ``required`` gives an empty prompt. A null value gives an empty
    prompt only where its placeholder is in use.
    """
    text = template
    for name, value in values:
        mark = placeholder(name)
        # replace() is null for a null value, which is the failure that the last coalesce catches
        text = F.when(text.contains(mark), F.replace(text, F.lit(mark), value)).otherwise(text)
    for needed in required:
        text = F.when(needed.isNotNull(), text)
    return F.coalesce(text, F.lit(""))


def _message(role: str, content: str) -> Column:
    return F.struct(F.col(role).alias("role"), F.col(content).alias("content"))


def history_window(
    turns: DataFrame,
    n_pairs: int,
    *,
    key: str = "dialogue_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    out: str = "history",
) -> DataFrame:
    """Add the last ``2 * n_pairs`` messages up to each turn. ``turn`` is dense from 0."""
    if n_pairs < 1:
        raise ValueError("n_pairs must be positive; use full_history on transcript rows to keep everything")
    return spans.trailing(
        turns, [key], turn, 2 * n_pairs, lambda w: {out: F.collect_list(_message(role, content)).over(w)}
    )


def full_history(turns: Column) -> Column:
    """For every turn of one transcript row, all turns up to it (a history setting of 0 never truncates)."""
    return F.transform(turns, lambda _, i: F.slice(turns, 1, i + 1))


def _alternates(messages: Column) -> Column:
    return F.forall(
        F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("model")),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )


def checked_context(messages: Column) -> Column:
    """The queue if it alternates user, model from its head; else its last message if from the user."""
    last = F.try_element_at(messages, F.lit(-1))
    return (
        F.when(_alternates(messages), messages)
        .when(last["role"] == "user", F.array(last))
        .otherwise(F.slice(messages, 1, 0))
    )


def fifo_context(
    turns: DataFrame,
    size: int = FIFO_MESSAGES,
    *,
    key: str = "dialogue_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    out: str = "context",
) -> DataFrame:
    """Add the request context of each turn: the last ``size`` messages, checked for alternation."""
    queued = spans.trailing(
        turns, [key], turn, size, lambda w: {"_queue": F.collect_list(_message(role, content)).over(w)}
    )
    return queued.withColumn(out, checked_context(F.col("_queue"))).drop("_queue")


def flatten_history(
    history: Column,
    new_input: Column,
    *,
    first_preamble: Column,
    preamble: Column,
    user_label: str = "User: ",
    model_label: str = "Model: ",
    quote_model: bool = False,
    unquote: bool = False,
) -> Column:
    """One prompt from earlier messages and the new input.

    Without history the prompt is ``first_preamble`` and the quoted input. ``unquote`` keeps only
    the second-last quoted piece of a user message that holds quotes; ``quote_model`` quotes model
    messages as well.
    """

    def line(m: Column) -> Column:
        said = m["content"]
        if unquote:
            said = F.when(said.contains('"'), F.try_element_at(F.split(said, '"'), F.lit(-2))).otherwise(said)
        quote = F.lit('"')
        model = F.concat(F.lit(model_label), quote, m["content"], quote) if quote_model else F.concat(
            F.lit(model_label), m["content"]
        )
        return F.when(m["role"] == "user", F.concat(F.lit(user_label), quote, said, quote)).otherwise(model)

    asked = F.concat(F.lit('"'), new_input, F.lit('"'))
    continued = F.concat(
        preamble, F.array_join(F.transform(history, line), "\n"), F.lit("\n" + user_label), asked
    )
    return F.when(F.size(history) > 0, continued).otherwise(F.concat(first_preamble, asked))


def flip_roles(messages: Column, mapping: Mapping[str, str], default: str) -> Column:
    """The dialogue as the other side sees it."""
    def flipped(role: Column) -> Column:
        out = F.lit(default)
        for old, new in mapping.items():
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    return F.transform(
        messages, lambda m: F.struct(flipped(m["role"]).alias("role"), m["content"].alias("content"))
    )


def build_judge_request(
    pairs: Column,
    rubric: Column,
    answer_fields: Sequence[str],
    fields: tuple[str, str] = ("user", "assistant"),
    prefixes: tuple[str, str] = ("", ""),
) -> Column:
    """Judge request of one document: rubric, an empty form per pair, then the pairs.

    The rubric is data; ``{{PAIR_COUNT}}``, ``{{ANSWER_FORM}}`` and ``{{PAIRS}}`` mark the insertion points.
    """
    form = F.array_join(
        F.transform(
            pairs,
            lambda _, i: F.concat(
                F.lit("\n" + PAIR_OPEN), (i + 1).cast("string"), F.lit(PAIR_CLOSE + "\n" + "".join(f"{f}\n" for f in answer_fields))
            ),
        ),
        "",
    )
    count = F.size(pairs).cast("string")
    text = rubric
    for name, value in (
        ("PAIR_COUNT", count),
        ("ANSWER_FORM", form),
        ("PAIRS", format_pairs(pairs, fields, prefixes)),
    ):
        text = F.replace(text, F.lit(placeholder(name)), value)
    return text


def extract_completion(
    raw: Column,
    *,
    open_mark: str = TURN_OPEN + "model",
    close_mark: str = TURN_CLOSE,
    cut_role_word: bool = False,
    failed: str = FAILED_COMPLETION,
) -> Column:
    """Answer text of a decoded generation, ``failed`` when no model turn was opened.

    ``cut_role_word`` also cuts through the first "model" in the answer; off by default because it
    removes legitimate text.
    """
    answer = py_strip(F.substring_index(F.substring_index(raw, open_mark, -1), close_mark, 1))
    if cut_role_word:
        at = F.locate("model", answer)
        answer = F.when(at > 0, py_strip(F.substr(answer, at + len("model")))).otherwise(answer)
    return F.when(raw.contains(open_mark), answer).otherwise(F.lit(failed))


def context_length(
    turns: DataFrame,
    *,
    key: str = "dialogue_id",
    turn: str = "turn",
    content: str = "text",
    overhead: int = 0,
    limit: int = CONTEXT_LIMIT,
    count=token_count,
) -> DataFrame:
    """Add ``context_tokens`` (tokens of the dialogue up to each turn) and ``over_limit``.

    ``overhead`` is the number of template tokens a message adds.
    """
    summed = spans.running_sum(
        turns, [key], turn, (count(F.col(content)) + overhead).cast("bigint"), "context_tokens"
    )
    return summed.withColumn("over_limit", F.col("context_tokens") > limit)


def pending_requests(config: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Config rows that have no finished dialogue yet."""
    return config.join(done.select(*keys).distinct(), list(keys), "left_anti")
