"""Transcripts rendered from ``conversations``, then parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import names as N
from colloquy.functions.text import is_blank, lines
from colloquy.functions.text import py_strip as strip_column
from colloquy.operators import pieces
from colloquy.operators import transcripts as X
from colloquy.plans.inputs import PAIRS, SPOKEN, dialogue_turns, spread, table
from colloquy.plans.registry import query

# What each reading of the log keeps of a text.
_CLEAN = """list_aggregate(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)),
  lambda x, i: x <> '' OR i = 1), 'string_agg', chr(10))"""
_JOINED = """list_aggregate(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)),
  lambda x: x <> ''), 'string_agg', ' ')"""
CLEAN_TEXT = _CLEAN.format(c="text")
_BODY = "string_agg(speaker || ': ' || text || chr(10) || chr(10), '' ORDER BY turn)"


def documents_of(spark, sf_dir):
    return X.render_transcripts(dialogue_turns(spark, sf_dir))


def numbered_pairs(spark, sf_dir):
    """Strictly parsed pairs ``(dialogue_id, pair_num, user, assistant)``."""
    pairs = X.explode_pairs(X.with_pairs(documents_of(spark, sf_dir)), "dialogue_id")
    return pairs.withColumn("pair_num", F.col("pair_num").cast("bigint"))


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def transcript_round_trip(spark, sf_dir):
    return X.explode_turns(X.with_turns(documents_of(spark, sf_dir)), "dialogue_id")


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, turn // 2 AS segment,
  string_agg(speaker || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS body
FROM spoken GROUP BY 1, 2"""
)
def segmented_transcripts(spark, sf_dir):
    """Two turns per document: the way a very long dialogue is rendered."""
    docs = X.render_transcripts(dialogue_turns(spark, sf_dir), segment_turns=2)
    return docs.select(
        "dialogue_id",
        F.col("segment").cast("bigint").alias("segment"),
        F.substr("content", F.lit(len(X.LOG_MARKER) + 3)).alias("body"),
    )


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def segmented_round_trip(spark, sf_dir):
    docs = X.render_transcripts(dialogue_turns(spark, sf_dir), segment_turns=2)
    return X.explode_turns(X.with_turns(docs), "dialogue_id", segment_turns=2)


@query(
    f"""WITH {SPOKEN}, d AS (SELECT dialogue_id, {_BODY} AS body FROM spoken GROUP BY 1)
SELECT dialogue_id, length('Verdict ' || dialogue_id) AS n_evaluation, trim(body, ' ' || chr(10)) AS log, true AS has_header FROM d"""
)
def split_sections(spark, sf_dir):
    docs = documents_of(spark, sf_dir)
    verdict = F.concat(F.lit("Verdict "), F.col("dialogue_id").cast("string"))
    rated = docs.select("dialogue_id", X.attach_evaluation(F.col("content"), verdict).alias("content"))
    return rated.select("dialogue_id", X.split_sections(F.col("content")).alias("s")).select(
        "dialogue_id",
        F.length("s.evaluation").alias("n_evaluation"),
        F.col("s.log").alias("log"),
        F.col("s.header").isNotNull().alias("has_header"),
    )


@query(
    f"""WITH {PAIRS} SELECT dialogue_id, pair_num,
  'User: ' || trim(string_split(user_text, chr(10))[1]) AS user_line,
  'Assistant: ' || {_JOINED.format(c="assistant_text")} AS assistant_line FROM pairs"""
)
def extract_pairs(spark, sf_dir):
    return numbered_pairs(spark, sf_dir).withColumnsRenamed({"user": "user_line", "assistant": "assistant_line"})


@query(
    f"""WITH {SPOKEN} SELECT p.dialogue_id, (p.turn + 1) // 2 AS pair_id, {_CLEAN.format(c="p.text")} AS prompt,
  {_CLEAN.format(c="r.text")} AS response
FROM spoken p JOIN spoken r ON p.dialogue_id = r.dialogue_id AND r.turn = p.turn + 1 WHERE p.turn % 2 = 1"""
)
def pair_turns(spark, sf_dir):
    parsed = X.with_turns(documents_of(spark, sf_dir))
    return parsed.select("dialogue_id", F.inline(X.pair_turns(F.col("turns"))))


def cut_documents(spark, sf_dir, size=29):
    """The documents in pieces of a few characters, every other one with CR LF line ends; borders fall anywhere."""
    ends = F.when(F.col("dialogue_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    docs = documents_of(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), ends))
    starts = F.sequence(F.lit(0), F.expr(f"length(content) div {size}"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("piece"), F.substr("content", i * size + 1, F.lit(size)).alias("content")))
    return docs.select("dialogue_id", F.inline(cut)).repartition(F.col("piece") % 64)


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def pieced_turns(spark, sf_dir):
    """Turns of documents cut at any character, read without putting a document together."""
    return pieces.turns_of_lines(pieces.log_lines(cut_documents(spark, sf_dir)))


@query(
    f"""WITH {PAIRS} SELECT dialogue_id, pair_num,
  'User: ' || trim(string_split(user_text, chr(10))[1]) AS user_line,
  'Assistant: ' || {_JOINED.format(c="assistant_text")} AS assistant_line FROM pairs"""
)
def pieced_pairs(spark, sf_dir):
    pairs = pieces.pairs_of_lines(pieces.log_lines(cut_documents(spark, sf_dir)))
    return pairs.withColumnsRenamed({"user": "user_line", "assistant": "assistant_line"})


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, turn // 3 AS piece,
  CASE WHEN turn // 3 = 0 THEN '=== Dialogue Log ===' || chr(10) || chr(10) ELSE '' END || {_BODY} AS content FROM spoken GROUP BY 1, 2"""
)
def rendered_pieces(spark, sf_dir):
    """One document for each dialogue, three turns to a piece."""
    found = pieces.render_pieces(dialogue_turns(spark, sf_dir), piece_turns=3)
    return found.select("dialogue_id", F.col("piece").cast("bigint").alias("piece"), "content")


@query(
    f"""WITH {PAIRS} SELECT dialogue_id, string_agg(chr(10) || '【ペア' || pair_num || '】' || chr(10)
  || 'User: ' || trim(string_split(user_text, chr(10))[1]) || chr(10)
  || 'Assistant: ' || {_JOINED.format(c="assistant_text")} || chr(10), '' ORDER BY pair_num) AS block
FROM pairs GROUP BY 1"""
)
def format_pairs(spark, sf_dir):
    pairs = X.with_pairs(documents_of(spark, sf_dir)).filter(F.size("pairs") > 0)
    return pairs.select("dialogue_id", X.format_pairs(F.col("pairs")).alias("block"))


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, dialogue_id % 5 = 0 AS doubled, string_agg(speaker || ': '
  || CASE WHEN dialogue_id % 5 = 0 THEN replace(text, ' ', '（' || turn || '）') || '（x' ELSE replace(text, ' ', '') END
  || chr(10) || chr(10), '' ORDER BY turn) AS body FROM spoken GROUP BY 1"""
)
def strip_parentheticals(spark, sf_dir):
    """Blanks turned into remarks, which go; a document with two markers is left as it is."""
    turns = dialogue_turns(spark, sf_dir)
    doubled = F.col("dialogue_id") % 5 == 0
    remark = F.concat(F.lit("（"), F.col("turn").cast("string"), F.lit("）"))
    remarked = F.concat(F.replace("text", F.lit(" "), remark), F.when(doubled, "（x").otherwise(""))
    docs = X.render_transcripts(turns.withColumn("text", remarked))
    content = X.strip_parentheticals(F.concat(F.when(doubled, X.LOG_MARKER).otherwise(""), "content"))
    head = F.when(doubled, 2 * len(X.LOG_MARKER)).otherwise(len(X.LOG_MARKER)) + 3
    return docs.select("dialogue_id", doubled.alias("doubled"), F.substr(content, head).alias("body"))


@query(
    f"""WITH {SPOKEN}, d AS (SELECT dialogue_id, dialogue_id % 2 = 0 AS rated, {_BODY} AS body FROM spoken GROUP BY 1)
SELECT dialogue_id, rated, CASE WHEN rated THEN 'Verdict ' || dialogue_id END AS evaluation,
  length('=== Dialogue Log ===') + 2 + length(body)
  + CASE WHEN rated THEN length('=== Quality Evaluation ===') + 1 + length('Verdict ' || dialogue_id) + 2 ELSE 0 END AS n_chars FROM d"""
)
def evaluated_transcripts(spark, sf_dir):
    verdict = F.concat(F.lit("Verdict "), F.col("dialogue_id").cast("string"))
    content = F.when(F.col("dialogue_id") % 2 == 0, X.attach_evaluation(F.col("content"), verdict)).otherwise(
        F.col("content")
    )
    docs = documents_of(spark, sf_dir).withColumn("content", content)
    return docs.select(
        "dialogue_id",
        X.is_evaluated(F.col("content")).alias("rated"),
        X.embedded_evaluation(F.col("content")).alias("evaluation"),
        F.length("content").alias("n_chars"),
    )


@query(
    """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(x, ' ' || chr(9) || chr(12288) || chr(13)) <> '') AS n_filled,
  sum(length(trim(x, ' ' || chr(9) || chr(12288) || chr(13))))::BIGINT AS n_stripped
FROM (SELECT doc_id, unnest(string_split(replace(text, ' ', '　 '), chr(10))) AS x FROM documents) GROUP BY 1"""
)
def py_strip(spark, sf_dir):
    """Strip every line of every document, with ideographic spaces put in."""
    padded = lines(F.replace("text", F.lit(" "), F.lit("　 ")))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.transform(padded, strip_column).alias("_l"))
    return docs.select(
        "doc_id",
        F.size("_l").alias("n_lines"),
        F.size(F.filter("_l", lambda x: ~is_blank(x))).alias("n_filled"),
        F.aggregate("_l", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_stripped"),
    )


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'base' END AS model_version,
  CASE WHEN event_type IN ('click', 'error') THEN 'checkpoint-' || user_id ELSE 'base' END AS checkpoint FROM events"""
)
def artifact_ids(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    path = (
        F.when(kind.isin("click", "error"), F.concat(F.lit("/srv/./models/"), kind, F.lit("//model/checkpoint-"), user))
        .when(kind == "view", F.concat(F.lit("models/"), kind, F.lit("/model")))
        .when(kind == "signup", F.concat(F.lit("/srv/other/checkpoint-"), user))
    )
    events = table(spark, sf_dir, "events").select("event_id", N.artifact_ids(path).alias("a"))
    return events.select("event_id", "a.*")


@query(
    """SELECT event_id, 'dialogue_' || CASE WHEN event_type = 'view' THEN 'base_default' ELSE event_type || '_checkpoint-' || user_id END
  || '_' || event_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' AS file_name,
  'dialogue_' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || user_id || '.txt' AS transcript_name FROM events"""
)
def dialogue_file_names(spark, sf_dir):
    tuned = F.col("event_type") != "view"
    return table(spark, sf_dir, "events").select(
        "event_id",
        N.dialogue_file_name(
            F.when(tuned, F.col("event_type")),
            F.when(tuned, F.concat(F.lit("checkpoint-"), F.col("user_id").cast("string"))),
            F.col("event_id"),
            F.col("ts"),
        ).alias("file_name"),
        N.transcript_file_name(F.col("event_type"), F.col("ts"), F.col("user_id")).alias("transcript_name"),
    )


_HEADER_SQL = "\n  || chr(10) || ".join(
    f"'{label}'" + (f" || {{{field[0]}}}" if field else "") for label, *field in X.HEADER_LINES
)


def header_settings(dialogue_id):
    """Settings of a document header made from the dialogue id; some titles and labels are missing."""
    number = dialogue_id.cast("string")
    settings = {field[0]: number for _, *field in X.HEADER_LINES if field}
    settings["persona_label"] = F.when(dialogue_id % 4 != 0, number)
    settings["user_prompt_title"] = F.when(dialogue_id % 7 != 0, F.concat(F.lit("title "), number))
    return settings


_SETTINGS_SQL = {field[0]: "dialogue_id" for _, *field in X.HEADER_LINES if field} | {
    "persona_label": "CASE WHEN dialogue_id % 4 <> 0 THEN dialogue_id::VARCHAR ELSE 'Error loading data' END",
    "user_prompt_title": "('title ' || dialogue_id)",
}


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, CASE WHEN dialogue_id % 7 = 0 THEN '' ELSE {_HEADER_SQL.format(**_SETTINGS_SQL)}
  || chr(10) || chr(10) END || '=== Dialogue Log ===' || chr(10) || chr(10) || {_BODY} AS content
FROM spoken GROUP BY dialogue_id"""
)
def transcript_headers(spark, sf_dir):
    turns = dialogue_turns(spark, sf_dir)
    header = X.transcript_header(header_settings(F.col("dialogue_id")))
    return X.render_transcripts(turns, header).select("dialogue_id", "content")
