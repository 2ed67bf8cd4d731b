"""Turns and pairs of a log that is cut into pieces, as if it were whole.

``transcripts`` reads a log from one cell. Here a log is any number of rows ``(key, piece, content)``, cut anywhere: between lines,
within a line, within a marker or between the two halves of a line end. No step holds more of a dialogue than one line or one
turn, so a dialogue may be as long as a table. A scan reads its rows several times, so each stage is a table in the shared folder.

What the reader of a whole log carries from line to line is an associative state: how many line ends, markers, speakers and
filled lines came before. Each is a prefix scan (``scans``) over rows ordered by place; a line then knows its line number, section, turn
and exchange by itself. Texts are put together by (dialogue, turn), never by dialogue.

Nulls: a null piece of text is an empty one; rows with a null key form one log. Blank pieces and empty tables are fine. ``piece`` may have
any type that Spark sorts and is unique within its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import SPACES, py_strip
from colloquy.operators import scans
from colloquy.operators.transcripts import ASSISTANT, LOG_MARKER, USER, transcript_header
from colloquy.session import stored


def _in_order(order: str, text: Column, separator: str) -> Column:
    """Texts of a group joined in the order of their places; null texts are left out."""
    entries = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t")))))
    return F.array_join(F.transform(entries, lambda e: e["t"]), separator)


def log_lines(pieces: DataFrame, key: str = "dialogue_id", piece: str = "piece", content: str = "content") -> DataFrame:
    """``(key, place, text)``: the lines between the first and the second log marker, line ends folded, ``place`` ascending.

    Logs without a marker have no lines.
    """
    cut = pieces.select(key, F.col(piece).alias("_piece"), F.split(F.coalesce(content, F.lit("")), "\n").alias("_parts"))
    ends = F.size("_parts") - 1
    cut = stored(cut, "log-pieces")
    counted = scans.running_sums(cut, [key], "_piece", _ends=ends.cast("bigint"))
    parts = counted.select(key, "_piece", "_ends", ends.alias("_n"), F.posexplode("_parts").alias("_at", "_part"))
    parts = parts.withColumn("_line", F.col("_ends") - F.col("_n") + F.col("_at"))
    # What stands between two line ends of one piece is a whole line; the first and last part of a piece may go on in the next.
    whole = (F.col("_at") > 0) & (F.col("_at") < F.col("_n"))
    joined = parts.filter(~whole).groupBy(key, "_line").agg(_in_order("_piece", F.col("_part"), "").alias("_part"))
    lines = parts.filter(whole).select(key, "_line", "_part").unionByName(joined)
    # A line end may be CR LF, CR or LF; LF has cut the lines already.
    folded = lines.select(key, "_line", F.posexplode(F.split(F.regexp_replace("_part", "\r$", ""), "\r")).alias("_sub", "_text"))
    placed = folded.select(key, F.struct("_line", "_sub").alias("place"), F.split("_text", LOG_MARKER).alias("_text"))
    marks = F.size("_text") - 1
    placed = stored(placed, "log-lines")
    sections = scans.running_sums(placed, [key], "place", _marks=marks.cast("bigint"))
    # Part j of a line is in section j plus the markers before the line.
    own = (1 - (F.col("_marks") - marks)).cast("int")
    text = F.when((own >= 0) & (own <= marks), F.get("_text", own))
    return stored(sections.select(key, "place", text.alias("text")).filter("text is not null"), "log-sections")


def _labelled(text: Column, *labels: str) -> Column:
    found = text.startswith(labels[0])
    for label in labels[1:]:
        found = found | text.startswith(label)
    return found


def turns_of_lines(lines: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """``(key, turn, speaker, text)``, the lenient reading of ``transcripts.parse_turns``."""
    text, bare = F.col("text"), py_strip(F.col("text"))
    opens, filled = _labelled(text, USER, ASSISTANT), bare != ""
    counted = scans.running_sums(lines, [key], "place", _turn=opens.cast("bigint"), _filled=filled.cast("bigint"))
    # The log as a whole is stripped, so its first filled line may be indented.
    first = filled & (F.col("_filled") == 1) & ~opens & _labelled(bare, USER, ASSISTANT)
    said = F.when(first, F.ltrim(text, F.lit(SPACES))).otherwise(text)
    starts = opens | first
    user = said.startswith(USER)
    rest = py_strip(F.when(user, F.substr(said, F.lit(len(USER) + 1))).otherwise(F.substr(said, F.lit(len(ASSISTANT) + 1))))
    marked = counted.select(
        key,
        "place",
        "_turn",
        F.when(starts, F.when(user, "User").otherwise("Assistant")).alias("_speaker"),
        F.when(starts, rest).when(filled, bare).alias("_said"),
    )
    turns = marked.groupBy(key, "_turn").agg(F.max("_speaker").alias("speaker"), _in_order("place", F.col("_said"), "\n").alias("text"))
    # Lines before the first speaker are a group without one.
    spoken = stored(turns.filter("speaker is not null"), "log-turns")
    return scans.with_position(spoken, [key], "_turn", "turn").select(key, "turn", "speaker", "text")


def pairs_of_lines(lines: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """``(key, pair_num, user, assistant)``, the strict reading of ``transcripts.extract_pairs``; numbers from 1."""
    bare = py_strip(F.col("text"))
    asks, answers = bare.startswith(USER), bare.startswith(ASSISTANT)
    counted = scans.running_sums(lines, [key], "place", _exchange=asks.cast("bigint"), _answer=answers.cast("bigint"))
    blocks = (
        counted.filter("_exchange > 0")
        .groupBy(key, "_exchange", "_answer")
        .agg(
            F.max(F.when(asks, bare)).alias("user"),
            F.max(answers).alias("_answers"),
            _in_order("place", F.when(bare != "", bare), " ").alias("_text"),
        )
    )
    # Of several answers the last one counts; lines of the user before the first one are no answer.
    exchanges = blocks.groupBy(key, "_exchange").agg(
        F.max("user").alias("user"),
        F.max_by(F.col("_text"), F.when(F.col("_answers"), F.col("_answer"))).alias("assistant"),
        F.max("_answers").alias("_answered"),
    )
    numbered = scans.with_position(stored(exchanges.filter("_answered"), "log-exchanges"), [key], "_exchange", "_nth")
    return numbered.select(key, (F.col("_nth") + 1).alias("pair_num"), "user", "assistant")


def render_pieces(
    turns: DataFrame, header: Column | None = None, *, key: str = "dialogue_id", piece_turns: int = 256
) -> DataFrame:
    """Pieces ``(key, piece, content)`` of one document for each dialogue, from long turns with ``turn`` dense from 0.

    Only the first piece has the header; the pieces in order are the document of ``transcripts.render_transcripts``. A group holds ``piece_turns``
    turns, whatever the length of the dialogue.
    """
    head = transcript_header() if header is None else header
    block = F.concat("speaker", F.lit(": "), "text", F.lit("\n\n"))
    return (
        turns.withColumn("_block", F.when(F.col("turn") == 0, F.concat(head, block)).otherwise(block))
        .groupBy(key, F.expr(f"turn div {piece_turns}").alias("piece"))
        .agg(_in_order("turn", F.col("_block"), "").alias("content"))
    )
