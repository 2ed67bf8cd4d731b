"""Sources and sinks: derived tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import names as N
from colloquy.operators import analytics as A
from colloquy.operators import pieces
from colloquy.operators import ratings as R
from colloquy.operators import transcripts as X
from colloquy.plans.example_queries import _CHAT, _MESSAGES, _long, chat_examples
from colloquy.plans.inputs import (
    CONFIG,
    RATINGS,
    RUN_LOG,
    SCORES,
    SPOKEN,
    dialogue_turns,
    pair_values,
    ratings,
    run_config,
    run_log,
    score_rows,
    table,
)
from colloquy.plans.registry import query
from colloquy.plans.transcript_queries import CLEAN_TEXT, documents_of, header_settings
from colloquy.session import shared_path
from colloquy.sources import readers as S
from colloquy.sources import writers as W
from colloquy.sources.manifest import FileManifest
from colloquy.streaming import jobs as J


def _transcripts(spark, sf_dir):
    """Documents as text with CRLF line ends; the header tells which dialogue it is."""
    settings = header_settings(F.col("dialogue_id")) | {"user_prompt_title": F.lit("title")}
    docs = X.render_transcripts(dialogue_turns(spark, sf_dir), X.transcript_header(settings))
    return docs.select(F.replace("content", F.lit("\n"), F.lit("\r\n")).alias("value"))


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def transcript_files(spark, sf_dir):
    """One text file per document."""
    path = shared_path(spark, "transcripts")
    W.write_file_each(_transcripts(spark, sf_dir), path)
    files = S.read_transcripts(spark, path)
    number = F.regexp_extract("content", r"(?m)^- Initial Question ID: (\d+)$", 1).try_cast("bigint")
    parsed = X.with_turns(files.withColumn("dialogue_id", number))
    return X.explode_turns(parsed, "dialogue_id")


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def transcript_line_files(spark, sf_dir):
    """The same files read line by line, in splits, as files that fit no cell are."""
    path = shared_path(spark, "transcript-lines")
    W.write_file_each(_transcripts(spark, sf_dir), path)
    lines = S.read_log_lines(spark, path)
    number = F.regexp_extract("content", r"^- Initial Question ID: (\d+)\s*$", 1).try_cast("bigint")
    names = lines.select("file_name", number.alias("dialogue_id")).filter("dialogue_id is not null")
    turns = pieces.turns_of_lines(pieces.log_lines(lines, "file_name"), "file_name")
    return turns.join(names, "file_name").select("dialogue_id", "turn", "speaker", "text")


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def stream_transcript_files(spark, sf_dir):
    """Text files that appear in a folder in two parts; each run of the stream parses those it has not seen."""
    folder, out, checkpoint = (shared_path(spark, n) for n in ("incoming", "incoming-turns", "incoming-checkpoint"))
    docs = _transcripts(spark, sf_dir)
    for part in (0, 1):
        W.write_file_each(docs.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == part), folder)
        files = S.stream_transcripts(spark, folder, 10_000)
        number = F.regexp_extract("content", r"(?m)^- Initial Question ID: (\d+)$", 1).try_cast("bigint")
        J.stream_turns(files.withColumn("dialogue_id", number), out, checkpoint, "dialogue_id").awaitTermination()
    return spark.read.parquet(out)


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text, CASE WHEN dialogue_id % 3 = 0 THEN 2 ELSE 1 END AS run,
  CASE WHEN dialogue_id % 3 = 0 THEN 'new' ELSE 'same' END AS status FROM spoken"""
)
def file_manifest(spark, sf_dir):
    """Two runs over a folder that grows: each parses what its manifest does not know; ``status`` is that of the second run."""
    folder, turns = shared_path(spark, "listed"), shared_path(spark, "listed-turns")
    manifest = FileManifest(spark, shared_path(spark, "manifest"))
    docs = _transcripts(spark, sf_dir)
    number = F.regexp_extract("content", r"(?m)^- Initial Question ID: (\d+)$", 1).try_cast("bigint")
    own = F.regexp_extract("value", r"(?m)^- Initial Question ID: (\d+)\r?$", 1).try_cast("bigint")
    for run, part in ((1, own % 3 != 0), (2, own % 3 == 0)):
        W.write_file_each(docs.filter(part), folder)
        path = shared_path(spark, "changes")
        manifest.changes(folder).write.parquet(path)
        changes = spark.read.parquet(path)
        parsed = X.with_turns(manifest.changed_transcripts(changes).withColumn("dialogue_id", number))
        X.explode_turns(parsed, "path", "dialogue_id").withColumn("run", F.lit(run)).write.mode("append").parquet(turns)
        manifest.save(changes)
    known = changes.select("path", "status")
    plain = spark.read.parquet(turns).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return plain.join(known.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path").drop("path")


@query(
    f"""WITH {CONFIG} SELECT dialogue_id::INT AS "INITIAL_QUESTION_ID", rounds::INT AS "MAX_TURNS", 0.3::DOUBLE AS "AI1_TEMPERATURE",
  CASE WHEN dialogue_id % 3 <> 0 THEN 0.7::DOUBLE END AS "AI2_TEMPERATURE", 'kw, "' || dialogue_id || '"' AS "DIALOGUE_KEYWORD",
  nullif(dialogue, '') AS dialogue FROM config"""
)
def run_config_csv(spark, sf_dir):
    """Quotes, bad numbers and rows without any value, written as CSV."""
    path = shared_path(spark, "config")
    number = F.col("dialogue_id").cast("string")
    rows = run_config(spark, sf_dir).select(
        F.lit("0.3").alias("AI1_TEMPERATURE"),
        F.when(F.col("dialogue_id") % 3 == 0, "warm").otherwise("0.7").alias("AI2_TEMPERATURE"),
        F.col("rounds").cast("string").alias("MAX_TURNS"),
        number.alias("INITIAL_QUESTION_ID"),
        F.concat(F.lit('kw, "'), number, F.lit('"')).alias("DIALOGUE_KEYWORD"),
        "dialogue",
    )
    empty = rows.select(*[F.lit(None).cast("string").alias(c) for c in rows.columns])
    rows.unionByName(empty).write.csv(path, header=True, escape='"', emptyValue="")
    return S.read_run_config(spark, path).drop("position")


@query(
    f"WITH {SCORES} "
    + """SELECT dialogue_id::VARCHAR AS dialogue_id, 'base' AS model_version, 'base' AS checkpoint,
  metric_type || '_pair' || pair_num AS metric_pair, metric_type, pair_num, number_score::DOUBLE AS score
FROM scores WHERE number_score IS NOT NULL"""
)
def ratings_csv(spark, sf_dir):
    """The wide table through CSV: cells are text, and NA stands for a missing key."""
    path = shared_path(spark, "wide")
    cells = score_rows(spark, sf_dir).withColumnRenamed("score_text", "score")
    wide = R.ratings_in_parts(cells, ["dialogue_id"], ("tone", "logic"))
    keyed = wide.select("*", F.lit("NA").alias("model_version"), F.lit("").alias("checkpoint"))
    keyed.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = A.fill_default_keys(S.read_ratings_wide(spark, path))
    return A.melt_ratings(read, ["dialogue_id", "model_version", "checkpoint"], part_width=2)


@query("SELECT 'questions' AS kind, p_partkey AS id, p_name AS title, p_name || ' text' AS content FROM part")
def catalog_json(spark, sf_dir):
    """Catalog objects of up to a thousand items, one per file, read back item by item."""
    path = shared_path(spark, "catalog")
    item = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.concat("p_name", F.lit(" text")).alias("content"),
    )
    catalogs = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 1000")).agg(F.collect_list(item).alias("questions"))
    catalogs.select("questions").write.option("maxRecordsPerFile", 1).json(path)
    return S.read_catalog(spark, path, "questions").select("kind", "id", "title", "content")


@query(f"WITH {SPOKEN}, {_CHAT} {_MESSAGES}")
def chat_corpus_files(spark, sf_dir):
    path = shared_path(spark, "corpus")
    W.write_chat_corpus(chat_examples(spark, sf_dir), path)
    return _long(S.read_chat_corpus(spark, path, json_lines=True))


def _scored_pairs(spark, sf_dir):
    """Pairs with nested ratings; every fourth dialogue is unrated."""
    pairs = pair_values(dialogue_turns(spark, sf_dir), "text").select(
        "dialogue_id",
        F.col("pair_num").alias("pair_id"),
        F.col("user_text").alias("prompt"),
        F.col("assistant_text").alias("response"),
    )
    score = F.when(F.col("dialogue_id") % 4 != 0, F.col("score").cast("bigint").cast("string")).otherwise("")
    parsed = ratings(spark, sf_dir).select(
        "dialogue_id", "pair_num", "metric_type", score.alias("quantitative"), F.lit("").alias("qualitative")
    )
    return W.scored_dialogues(pairs, parsed)


@query(
    f"""WITH {RATINGS} SELECT p.dialogue_id, p.pair_num AS pair_id, p.user_text AS prompt, p.assistant_text AS response,
  CASE WHEN dialogue_id % 4 = 0 THEN '' ELSE tone::VARCHAR END AS tone, CASE WHEN dialogue_id % 4 = 0 THEN '' ELSE logic::VARCHAR END AS logic
FROM pairs p JOIN rating_pairs USING (dialogue_id, pair_num)"""
)
def scored_pairs_json(spark, sf_dir):
    """One nested row per pair as JSON lines."""
    path = shared_path(spark, "scored")
    scored = _scored_pairs(spark, sf_dir)
    W.write_scored_dialogues(scored, path)
    return spark.read.schema(scored.schema).json(path).select(
        "dialogue_id",
        "pair_id",
        "prompt",
        "response",
        F.col("evaluation.tone.quantitative").alias("tone"),
        F.col("evaluation.logic.quantitative").alias("logic"),
    )


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, model_version, p.pair_num AS pair_id, user_text AS prompt, assistant_text AS response,
  CASE WHEN dialogue_id % 4 = 0 THEN '' ELSE tone::VARCHAR END AS tone, dialogue_id % 4 <> 0 AS rated
FROM pairs p JOIN rating_pairs USING (dialogue_id, pair_num)"""
)
def scored_dialogue_documents(spark, sf_dir):
    """Nested dialogue documents, one file each, and the rated check on them."""
    path = shared_path(spark, "scored-documents")
    metadata = run_config(spark, sf_dir).select(
        "dialogue_id",
        F.struct(
            F.col("dialogue_id").alias("question_id"),
            F.element_at(
                F.array(F.lit("base"), F.lit("tuned_a"), F.lit("tuned_b")), (F.col("dialogue_id") % 3 + 1).cast("int")
            ).alias("model_version"),
        ).alias("metadata"),
    )
    W.write_scored_dialogues(W.nest_dialogues(_scored_pairs(spark, sf_dir), metadata), path, one_per_file=True)
    read = S.read_scored_dialogues(spark, path)
    return read.select(
        F.col("metadata.question_id").alias("dialogue_id"),
        F.col("metadata.model_version").alias("model_version"),
        R.is_fully_rated(F.col("pairs")).alias("rated"),
        F.explode("pairs").alias("p"),
    ).select(
        "dialogue_id",
        "model_version",
        F.col("p.pair_id").alias("pair_id"),
        F.col("p.claude.content").alias("prompt"),
        F.col("p.gemma.content").alias("response"),
        F.col("p.evaluation.tone.quantitative").alias("tone"),
        "rated",
    )


@query(
    f"""WITH {SCORES}, averages AS (SELECT dialogue, avg(digit_score) AS a FROM scores WHERE dialogue <> '' GROUP BY 1)
, docs AS (SELECT c.dialogue, c.dialogue_id, string_agg(speaker || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS body
  FROM config c JOIN spoken USING (dialogue_id) GROUP BY 1, 2)
SELECT dialogue_id, CASE WHEN a <= 2 THEN 'low' WHEN a IS NOT NULL THEN 'ok' ELSE 'unrated' END AS rating_bucket,
  length(body) + 22 AS n_chars FROM docs LEFT JOIN averages USING (dialogue)"""
)
def routed_transcripts(spark, sf_dir):
    """The rating flow end to end: scores, verdicts, and transcripts written below their verdict."""
    from colloquy.plans.jobs import rating_verdicts

    path = shared_path(spark, "routed")
    names = run_config(spark, sf_dir).select("dialogue_id", "dialogue")
    verdicts = rating_verdicts(score_rows(spark, sf_dir), names)
    W.route_low_rated(documents_of(spark, sf_dir).join(names, "dialogue_id"), verdicts, path)
    routed = spark.read.parquet(path)
    return routed.select("dialogue_id", "rating_bucket", F.length("content").alias("n_chars"))


@query(
    f"""WITH {RATINGS} SELECT model_version, checkpoint, metric_type, round(avg(score), 6) AS mean, count(*) AS count
FROM ratings GROUP BY 1, 2, 3"""
)
def summary_csv(spark, sf_dir):
    path = shared_path(spark, "summary")
    W.write_summary(A.summary_stats(ratings(spark, sf_dir), digits=None), path)
    schema = "model_version string, checkpoint string, metric_type string, mean double, std double, min double, max double, count bigint"
    read = spark.read.schema(schema).csv(path, header=True)
    return read.select("model_version", "checkpoint", "metric_type", F.round("mean", 6).alias("mean"), "count")


@query(f"WITH {RUN_LOG} SELECT run_id, step, round(loss, 6) AS loss, round(loss, 6) AS history_loss FROM run_log")
def run_log_files(spark, sf_dir):
    """Metrics CSV and history JSON of the same log."""
    path = shared_path(spark, "runlog")
    log = run_log(table(spark, sf_dir, "events"))
    W.write_run_log(log, path)
    schema = "run_id bigint, ts timestamp, step bigint, loss double, learning_rate double, epoch double"
    metrics = spark.read.schema(schema).csv(f"{path}/metrics", header=True).select("run_id", "step", "loss")
    history = spark.read.schema(schema).json(f"{path}/history").select("step", F.col("loss").alias("history_loss"))
    return metrics.join(history, "step").withColumns(
        {c: F.round(c, 6) for c in ("loss", "history_loss")}
    ).select("run_id", "step", "loss", "history_loss")


@query(
    """SELECT 'dialogue_' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || user_id || '.txt' AS file_name, user_id AS turns
FROM events"""
)
def turns_from_transcript_name(spark, sf_dir):
    name = N.transcript_file_name(F.col("event_type"), F.col("ts"), F.col("user_id"))
    names = table(spark, sf_dir, "events").select(name.alias("file_name"))
    return names.withColumn("turns", N.turns_from_name(F.col("file_name")))
