"""Run-config, listing and incremental operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import names as N
from colloquy.operators import config_table as C
from colloquy.plans.inputs import CONFIG, RATINGS, SPOKEN, ratings, run_config, table
from colloquy.plans.registry import query
from colloquy.plans.rating_queries import GAP, two_metric_answers
from colloquy.plans.transcript_queries import CLEAN_TEXT, documents_of
from colloquy.session import shared_path
from colloquy.sources.writers import current_ratings
from colloquy.streaming import jobs as J


def _keyed_events(spark, sf_dir):
    """Config rows with null keys and repeats."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 90).alias("question_id"), kind.alias("model_version"), "value"
    )


_KEYED = """keyed AS (SELECT event_id, user_id % 90 AS question_id,
  CASE WHEN event_type <> 'error' THEN event_type END AS model_version, value FROM events)"""


@query(
    f"""WITH {_KEYED} SELECT event_id, question_id, model_version,
  count(*) OVER (PARTITION BY question_id, model_version) > 1 AS is_duplicate FROM keyed"""
)
def flag_duplicates(spark, sf_dir):
    return C.flag_duplicates(_keyed_events(spark, sf_dir).drop("value"), "question_id", "model_version")


@query(
    f"""WITH {_KEYED} SELECT * FROM keyed
QUALIFY row_number() OVER (PARTITION BY question_id, model_version ORDER BY event_id) = 1"""
)
def drop_duplicates_keep_first(spark, sf_dir):
    return C.drop_duplicates_keep_first(
        _keyed_events(spark, sf_dir), "question_id", "model_version", position="event_id"
    )


@query(
    """SELECT event_id, user_id, user_id IN (SELECT s_suppkey FROM supplier) AS known FROM events"""
)
def check_catalog_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    catalog = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    kept, unknown = C.check_catalog_ids(events, catalog, "user_id")
    return kept.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query(f"WITH {CONFIG} SELECT dialogue_id, rounds FROM config WHERE dialogue_id % 4 = 0 OR dialogue = ''")
def pending_rows(spark, sf_dir):
    blank = F.when(F.col("dialogue_id") % 8 == 0, "　 ").when(F.col("dialogue_id") % 4 != 0, F.col("dialogue"))
    config = run_config(spark, sf_dir).withColumn("dialogue", blank)
    return C.pending_rows(config).select("dialogue_id", "rounds")


@query(
    f"""WITH {RATINGS}, rows AS (SELECT DISTINCT dialogue_id, nullif(model_version, 'base') AS model_version,
    nullif(checkpoint, 'base') AS checkpoint FROM ratings)
SELECT dialogue_id, model_version, checkpoint, CASE WHEN dialogue_id % 2 = 0 THEN 'old_' || dialogue_id
  ELSE 'dialogue_' || coalesce(model_version, 'base') || '_' || coalesce(checkpoint, 'default') || '_' || dialogue_id || '.json'
  END AS dialogue FROM rows"""
)
def record_outputs(spark, sf_dir):
    """Odd dialogues were produced now; base rows have null keys and are recorded as well."""
    keys = ["dialogue_id", "model_version", "checkpoint"]
    rows = ratings(spark, sf_dir).select(
        "dialogue_id",
        F.nullif("model_version", F.lit("base")).alias("model_version"),
        F.nullif("checkpoint", F.lit("base")).alias("checkpoint"),
    ).distinct()
    number = F.col("dialogue_id").cast("string")
    odd = F.col("dialogue_id") % 2 == 1
    config = rows.withColumn("dialogue", F.when(~odd, F.concat(F.lit("old_"), number)))
    name = F.concat(
        F.lit("dialogue_"),
        F.coalesce("model_version", F.lit(N.BASE)),
        F.lit("_"),
        F.coalesce("checkpoint", F.lit("default")),
        F.lit("_"),
        number,
        F.lit(".json"),
    )
    produced = rows.filter(odd).withColumn("dialogue", name)
    return C.record_outputs(config, produced, keys)


@query(
    """SELECT user_id, 'checkpoint-' || max(event_id) FILTER (event_type IN ('click', 'view')) AS name
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"""
)
def latest_checkpoint(spark, sf_dir):
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    name = (
        F.when(kind.isin("click", "view"), F.concat(F.lit("checkpoint-"), number))
        .when(kind == "error", F.concat(F.lit("checkpoint-x"), number))
        .otherwise(number)
    )
    listing = table(spark, sf_dir, "events").select("user_id", name.alias("name"))
    return C.latest_checkpoint(listing, "user_id")


@query(
    """SELECT event_type AS keyword, user_id AS turns,
  arg_max('dialogue_' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || user_id || '.txt', ts) AS file_name
FROM events GROUP BY 1, 2"""
)
def latest_file(spark, sf_dir):
    name = N.transcript_file_name(F.col("event_type"), F.col("ts"), F.col("user_id"))
    files = table(spark, sf_dir, "events").select(name.alias("file_name"), F.col("ts").alias("modified"))
    return C.latest_file(files)


@query(f"WITH {SPOKEN} SELECT dialogue_id, turn, speaker, {CLEAN_TEXT} AS text FROM spoken")
def stream_transcripts(spark, sf_dir):
    """Documents arrive in two parts; the second run picks up only what is new."""
    docs, out = shared_path(spark, "documents"), shared_path(spark, "turns")
    checkpoint = shared_path(spark, "turns-checkpoint")
    rendered = documents_of(spark, sf_dir).select("dialogue_id", "segment", "content")
    for part in (0, 1):
        rendered.filter(F.col("dialogue_id") % 2 == part).write.mode("append").parquet(docs)
        source = spark.readStream.schema(rendered.schema).option("maxFilesPerTrigger", 64).parquet(docs)
        J.stream_turns(source, out, checkpoint, "dialogue_id").awaitTermination()
    return spark.read.parquet(out)


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, metric_type, pair_num, score FROM ratings
WHERE metric_type IN ('tone', 'logic') AND NOT {GAP}"""
)
def stream_ratings(spark, sf_dir):
    """Judge answers arrive as files and end up in one rating store, through two streams of their own."""
    store = shared_path(spark, "store")
    for part in (0, 1):
        answers = shared_path(spark, f"answers-{part}")
        two_metric_answers(spark, sf_dir).filter(F.col("dialogue_id") % 2 == part).write.parquet(answers)
        source = spark.readStream.schema("dialogue_id bigint, answer string").parquet(answers)
        J.stream_ratings(source, store, shared_path(spark, "store-checkpoint")).awaitTermination()
    return current_ratings(spark, store)
