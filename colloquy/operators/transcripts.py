"""Transcript text to turns and pairs, and back.

Parsing works on one transcript row at a time with array functions, so it never shuffles. Long
tables of turns are rendered in documents of at most ``segment_turns`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.plan import exploded, let
from colloquy.functions.text import fold_newlines, lines, py_strip, stripped_lines

# Markers and labels of the transcript format.
LOG_MARKER = "=== Dialogue Log ==="
EVALUATION_MARKER = "=== Quality Evaluation ==="
USER = "User:"
ASSISTANT = "Assistant:"
PAIR_OPEN = "【ペア"
PAIR_CLOSE = "】"
ROLE_SPEAKERS = {"user": "User", "assistant": "Assistant"}
HEADER_LINES = (
    ("AI1 (User) Parameters:",),
    ("- Model: ", "ai1_model"),
    ("- Max Tokens: ", "ai1_max_tokens"),
    ("- Temperature: ", "ai1_temperature"),
    ("",),
    ("AI2 (Assistant) Parameters:",),
    ("- Model: ", "ai2_model"),
    ("- Max Tokens: ", "ai2_max_tokens"),
    ("- Temperature: ", "ai2_temperature"),
    ("",),
    ("Global Settings:",),
    ("- Max Message Pairs: ", "max_message_pairs"),
    ("- Max Turns: ", "max_turns"),
    ("- Initial Question ID: ", "initial_question_id"),
    ("",),
    ("User Details:",),
    ("- User Prompt ID: ", "user_prompt_id"),
    ("- Title: ", "user_prompt_title"),
    ("- Others:",),
    ("  - ID: ", "others_id"),
    ("  - Label: ", "others_label"),
    ("- Persona:",),
    ("  - ID: ", "persona_id"),
    ("  - Label: ", "persona_label"),
    ("- Transform:",),
    ("  - ID: ", "transform_id"),
    ("  - Label: ", "transform_label"),
    ("",),
    ("Assistant Details:",),
    ("- Assistant Prompt ID: ", "assistant_prompt_id"),
    ("- Title: ", "assistant_prompt_title"),
    ("- Response:",),
    ("  - ID: ", "response_id"),
    ("  - Label: ", "response_label"),
    ("- Update:",),
    ("  - ID: ", "update_id"),
    ("  - Label: ", "update_label"),
)
MISSING_LABEL = "Error loading data"

# (?d): only "\n" ends a line, so U+2028 inside an utterance does not split it.
_TURN_START = r"(?md)^(?=User:|Assistant:)"
_USER_START = r"(?Umd)^(?=[\s\x1c-\x1f&&[^\n]]*User:)"
_ASSISTANT_START = r"(?Umd)^(?=[\s\x1c-\x1f&&[^\n]]*Assistant:)"


def _pieces_after(text: Column, marker: str) -> Column:
    """Text between the first and the second marker, null without a marker."""
    return F.get(F.split(text, marker), F.lit(1))


def split_sections(content: Column) -> Column:
    """``struct(header, evaluation, log)``; ``log`` is null when the marker is absent."""
    return F.struct(
        F.when(content.contains(LOG_MARKER), F.substring_index(content, LOG_MARKER, 1)).alias("header"),
        embedded_evaluation(content).alias("evaluation"),
        py_strip(_pieces_after(content, LOG_MARKER)).alias("log"),
    )


def _utterance(block: Column, prefix: str) -> Column:
    def joined(block_lines: Column) -> Column:
        rest = F.filter(F.slice(block_lines, 2, F.size(block_lines)), lambda line: line != "")
        return F.array_join(F.concat(F.slice(block_lines, 1, 1), rest), "\n")

    return let(F.transform(lines(F.substr(block, F.lit(len(prefix) + 1))), py_strip), joined)


def parse_turns(log: Column) -> Column:
    """Ordered ``array<struct<speaker, text>>`` of a log, the lenient reading.

    A line that starts with a speaker label opens a turn; other non-blank lines continue it; text
    before the first speaker is dropped.
    """
    blocks = F.filter(
        F.split(py_strip(log), _TURN_START), lambda b: b.startswith(USER) | b.startswith(ASSISTANT)
    )
    return F.transform(
        blocks,
        lambda b: F.when(
            b.startswith(USER), F.struct(F.lit("User").alias("speaker"), _utterance(b, USER).alias("text"))
        ).otherwise(F.struct(F.lit("Assistant").alias("speaker"), _utterance(b, ASSISTANT).alias("text"))),
    )


def extract_pairs(log: Column) -> Column:
    """Ordered ``array<struct<user, assistant>>`` of a log, the strict reading used for rating.

    Speaker labels stay in the text and may be indented. Continuation lines of a user are dropped,
    those of an assistant are joined by a space; of several assistant answers the last one counts.
    """
    exchanges = F.filter(F.split(py_strip(log), _USER_START), lambda e: py_strip(e).startswith(USER))
    pairs = F.transform(
        exchanges,
        lambda e: F.struct(
            F.get(stripped_lines(e), F.lit(0)).alias("user"),
            F.array_join(
                stripped_lines(
                    F.try_element_at(
                        F.filter(F.split(e, _ASSISTANT_START), lambda a: py_strip(a).startswith(ASSISTANT)),
                        F.lit(-1),
                    )
                ),
                " ",
            ).alias("assistant"),
        ),
    )
    return F.filter(pairs, lambda p: p["assistant"].isNotNull())


def pair_turns(turns: Column) -> Column:
    """``array<struct<pair_id, prompt, response>>``: drop the topic, then pair up; no odd tail."""
    n = F.floor((F.size(turns) - 1) / 2).cast("int")
    made = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda k: F.struct(
            k.cast("int").alias("pair_id"),
            F.get(turns, 2 * k - 1)["text"].alias("prompt"),
            F.get(turns, 2 * k)["text"].alias("response"),
        ),
    )
    return F.when(n >= 1, made).otherwise(F.filter(made, lambda _: F.lit(False)))


def format_pairs(
    pairs: Column, fields: tuple[str, str] = ("user", "assistant"), prefixes: tuple[str, str] = ("", "")
) -> Column:
    """Numbered blocks of an array of pairs, ready for a judge request."""
    return F.array_join(
        F.transform(
            pairs,
            lambda p, i: F.concat(
                F.lit("\n" + PAIR_OPEN),
                (i + 1).cast("string"),
                F.lit(PAIR_CLOSE + "\n" + prefixes[0]),
                p[fields[0]],
                F.lit("\n" + prefixes[1]),
                p[fields[1]],
                F.lit("\n"),
            ),
        ),
        "",
    )


def strip_parentheticals(content: Column) -> Column:
    """Delete full-width parenthesised remarks from the log of a document with exactly one marker."""
    parts = F.split(content, LOG_MARKER)
    cleaned = F.concat(
        F.get(parts, F.lit(0)), F.lit(LOG_MARKER), F.regexp_replace(F.get(parts, F.lit(1)), "（[^）]*）", "")
    )
    return F.when(F.size(parts) == 2, cleaned).otherwise(content)


def is_evaluated(content: Column) -> Column:
    return py_strip(F.substring_index(content, "\n", 1)) == EVALUATION_MARKER


def embedded_evaluation(content: Column) -> Column:
    """Evaluation text in front of the log, null when there is none."""
    return py_strip(F.get(F.split(_pieces_after(content, EVALUATION_MARKER), LOG_MARKER), F.lit(0)))


def attach_evaluation(content: Column, evaluation: Column) -> Column:
    return F.concat(F.lit(EVALUATION_MARKER + "\n"), evaluation, F.lit("\n\n"), content)


def with_turns(transcripts: DataFrame, content: str = "content") -> DataFrame:
    """Add ``turns`` to transcript rows; documents without a log marker get null."""
    log = _pieces_after(fold_newlines(F.col(content)), LOG_MARKER)
    return transcripts.withColumn("turns", parse_turns(log))


def with_pairs(transcripts: DataFrame, content: str = "content") -> DataFrame:
    """Add ``pairs`` to transcript rows; documents without a log marker get an empty array."""
    log = _pieces_after(fold_newlines(F.col(content)), LOG_MARKER)
    return transcripts.withColumn("pairs", extract_pairs(F.coalesce(log, F.lit(""))))


def explode_turns(parsed: DataFrame, *keys: str, segment_turns: int | None = None) -> DataFrame:
    """Long ``(keys, turn, speaker, text)`` view.

    For documents that ``render_transcripts`` cut, give the same ``segment_turns``: ``turn`` then counts on across them.
    """
    segmented = segment_turns is not None
    first = F.col("segment") * segment_turns if segmented else F.lit(0)
    return exploded(parsed, "turns", *keys, *(["segment"] if segmented else [])).select(
        *keys,
        (first + F.col("_pos")).cast("bigint").alias("turn"),
        F.col("_item.speaker").alias("speaker"),
        F.col("_item.text").alias("text"),
    )


def explode_pairs(paired: DataFrame, *keys: str) -> DataFrame:
    """Long ``(keys, pair_num, user, assistant)`` view of ``pairs``, numbered from 1 in each document."""
    return exploded(paired, "pairs", *keys).select(
        *keys,
        (F.col("_pos") + 1).alias("pair_num"),
        F.col("_item.user").alias("user"),
        F.col("_item.assistant").alias("assistant"),
    )


def transcript_header(settings: dict[str, Column] | None = None) -> Column:
    """Document header; the short form when no settings are known or a prompt title is missing.

    A missing attribute label reads as ``MISSING_LABEL``; a missing prompt title leaves the marker only.
    """
    short = F.lit(LOG_MARKER + "\n\n")
    if settings is None:
        return short
    parts = []
    for label, *field in HEADER_LINES:
        value = F.lit("")
        if field:
            value = settings[field[0]].cast("string")
            fallback = MISSING_LABEL if field[0].endswith("_label") else None
            value = F.coalesce(value, F.lit(fallback)) if fallback else value
        parts += [F.lit(label), value, F.lit("\n")]
    # concat is null as soon as one part is, which is what selects the short header
    return F.coalesce(F.concat(*parts, F.lit("\n"), short), short)


def render_transcripts(
    turns: DataFrame,
    header: Column | None = None,
    *,
    key: str = "dialogue_id",
    segment_turns: int | None = None,
) -> DataFrame:
    """Documents ``(key, segment, content)`` from long turns ``(key, turn, speaker, text)``.

    ``turn`` is dense from 0. A dialogue is one document, whatever its length, as a file holds it. Only where
    ``segment_turns`` is given, it continues in further documents, each a transcript of its own.
    ``header`` may use the columns of ``turns`` that are constant within a dialogue.
    """
    head = transcript_header() if header is None else header
    blocks = F.sort_array(F.collect_list(F.struct("turn", F.concat("speaker", F.lit(": "), "text", F.lit("\n\n")))))
    body = F.array_join(F.transform(blocks, lambda b: b["col2"]), "")
    return (
        turns.withColumn("segment", F.lit(0).cast("bigint") if segment_turns is None else F.expr(f"turn div {segment_turns}"))
        .withColumn("_head", F.when(F.col("turn") == F.col("segment") * (segment_turns or 0), head))
        .groupBy(key, "segment")
        .agg(F.max("_head").alias("_head"), body.alias("_body"))
        .select(
            key,
            "segment",
            F.concat(
                F.when(F.col("segment") == 0, F.col("_head")).otherwise(transcript_header()), "_body"
            ).alias("content"),
        )
    )
