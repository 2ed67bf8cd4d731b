"""Operator inputs derived from the driver tables, each with the SQL that derives the same.

The tables hold conversations but no ratings, file names or judge answers. Those are computed from
the conversations by fixed rules; they exercise the operators and mean nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.scores import DIGITS, FULL_WIDTH_DIGITS
from colloquy.operators import spans
from colloquy.operators.transcripts import ROLE_SPEAKERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores before costly work on each, where the input has fewer splits than there are cores.

    A large table has more splits than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _is_spoken() -> Column:
    return F.coalesce(F.col("role").isin(*ROLE_SPEAKERS), F.lit(False))


def numbered_turns(spark: SparkSession, sf_dir: str, size: Callable[[Column], Column] | None = None) -> DataFrame:
    """Turns ``(dialogue_id, turn, role, text)``, ``turn`` dense from 0; with ``size``, its sum over a turn's messages as ``size``.

    The transcript format knows two speakers. A message of neither, such as a system message, stands in front of the turn
    that follows it, as chat templates without such a role have it; at the end of a dialogue it is a turn of the user.
    Messages of one turn are joined by a line feed. With ``size`` no text is shuffled.
    """
    said = F.col("text") if size is None else size(F.col("text")).cast("bigint")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("_at"), "role", said.alias("_said")
    )
    spoken = _is_spoken().cast("bigint")
    placed = spans.running_sum(rows, ["dialogue_id"], "_at", spoken, "_through").withColumn("turn", F.col("_through") - spoken)
    if size is None:
        messages = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_said"))), lambda m: m["_said"])
        value = F.when(F.count("_said") > 0, F.array_join(messages, "\n")).alias("text")
    else:
        value = F.sum("_said").alias("size")
    role = F.coalesce(F.max(F.when(_is_spoken(), F.col("role"))), F.lit("user"))
    return placed.groupBy("dialogue_id", "turn").agg(role.alias("role"), value, F.count("_said").alias("n_messages"))


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the ``speaker`` of the transcript format."""
    speaker = F.when(F.col("role") == "user", ROLE_SPEAKERS["user"]).otherwise(ROLE_SPEAKERS["assistant"])
    return numbered_turns(spark, sf_dir).select("dialogue_id", "turn", "role", speaker.alias("speaker"), "text")


SPOKEN = """messages AS (
  SELECT conv_id AS dialogue_id, turn AS place, role, text, coalesce(role IN ('user', 'assistant'), false) AS heard
  FROM conversations
), placed AS (
  SELECT *, count(*) FILTER (heard) OVER (PARTITION BY dialogue_id ORDER BY place) - heard::INT AS turn FROM messages
), spoken AS (
  SELECT dialogue_id, turn, coalesce(max(role) FILTER (heard), 'user') AS role, string_agg(text, chr(10) ORDER BY place) AS text,
         CASE WHEN max(role) FILTER (heard) = 'assistant' THEN 'Assistant' ELSE 'User' END AS speaker
  FROM placed GROUP BY dialogue_id, turn)"""


def pair_values(turns: DataFrame, *columns: str) -> DataFrame:
    """Even turn and the odd turn behind it in one row; a group holds two rows at most."""
    def at(parity: int, c: str) -> Column:
        return F.max(F.when(F.pmod("turn", F.lit(2)) == parity, F.col(c)))

    return (
        turns.groupBy("dialogue_id", (F.expr("turn div 2") + 1).alias("pair_num"))
        .agg(
            F.count("*").alias("_n"),
            *[at(0, c).alias(f"user_{c}") for c in columns],
            *[at(1, c).alias(f"assistant_{c}") for c in columns],
        )
        .filter("_n = 2")
        .drop("_n")
    )


PAIRS = (
    SPOKEN
    + """, pairs AS (
  SELECT dialogue_id, turn // 2 + 1 AS pair_num,
         max(text) FILTER (turn % 2 = 0) AS user_text, max(text) FILTER (turn % 2 = 1) AS assistant_text
  FROM spoken GROUP BY 1, 2 HAVING count(*) = 2)"""
)


def _model() -> tuple[Column, Column]:
    model = F.element_at(
        F.array(F.lit("base"), F.lit("tuned_a"), F.lit("tuned_b")), (F.col("dialogue_id") % 3 + 1).cast("int")
    )
    checkpoint = F.when(F.col("dialogue_id") % 3 == 0, "base").otherwise(
        F.concat(F.lit("checkpoint-"), (100 * (1 + F.col("dialogue_id") % 5)).cast("string"))
    )
    return model.alias("model_version"), checkpoint.alias("checkpoint")


_MODEL_SQL = """CASE dialogue_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'tuned_a' ELSE 'tuned_b' END AS model_version,
         CASE WHEN dialogue_id % 3 = 0 THEN 'base'
              ELSE 'checkpoint-' || (100 * (1 + dialogue_id % 5))::VARCHAR END AS checkpoint"""


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with text lengths only: lengths are taken at the scan, so no text is shuffled."""
    sizes = numbered_turns(spark, sf_dir, F.length)
    # the line feeds between the messages of a turn count as well
    return pair_values(sizes.withColumn("len", F.col("size") + F.col("n_messages") - 1), "len")


def rating_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores per pair, in columns."""
    user, assistant = F.col("user_len"), F.col("assistant_len")
    return pair_lengths(spark, sf_dir).select(
        "dialogue_id",
        *_model(),
        F.col("pair_num").cast("int").alias("pair_num"),
        (assistant % 5).alias("tone"),
        (user % 5).alias("approach"),
        ((user + assistant) % 5).alias("format"),
        ((F.col("dialogue_id") + F.col("pair_num")) % 5).alias("logic"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rating table."""
    metrics = ("tone", "approach", "format", "logic")
    rows = F.array(*[F.struct(F.lit(m).alias("metric_type"), F.col(m).cast("double").alias("score")) for m in metrics])
    return rating_pairs(spark, sf_dir).select(
        "dialogue_id", "model_version", "checkpoint", "pair_num", F.inline(rows)
    )


RATINGS = (
    PAIRS
    + f""", rating_pairs AS (
  SELECT dialogue_id, {_MODEL_SQL}, pair_num,
         length(assistant_text) % 5 AS tone, length(user_text) % 5 AS approach,
         (length(user_text) + length(assistant_text)) % 5 AS format, (dialogue_id + pair_num) % 5 AS logic
  FROM pairs), ratings AS (
  SELECT dialogue_id, model_version, checkpoint, pair_num, 'tone' AS metric_type, tone::DOUBLE AS score FROM rating_pairs
  UNION ALL SELECT dialogue_id, model_version, checkpoint, pair_num, 'approach', approach::DOUBLE FROM rating_pairs
  UNION ALL SELECT dialogue_id, model_version, checkpoint, pair_num, 'format', format::DOUBLE FROM rating_pairs
  UNION ALL SELECT dialogue_id, model_version, checkpoint, pair_num, 'logic', logic::DOUBLE FROM rating_pairs)"""
)


def _dialogue_name(dialogue_id: Column, rounds: Column) -> Column:
    number = dialogue_id.cast("string")
    return (
        F.when(dialogue_id % 10 == 9, "")
        .when(dialogue_id % 10 == 7, F.concat(F.lit("dialogue_c"), number, F.lit("_x.txt")))
        .otherwise(F.concat(F.lit("dialogue_c"), number, F.lit("_"), rounds.cast("string"), F.lit(".txt")))
    )


def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dialogue ``(dialogue_id, dialogue, rounds)``; some names are blank or lack a turn count."""
    # a plain partial aggregation: spoken messages, and one turn more where the last message is of neither speaker
    last = F.max_by(_is_spoken(), "turn")
    turns = F.count(F.when(_is_spoken(), 1)) + F.when(last, 0).otherwise(1)
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("dialogue_id"))
        .agg(turns.alias("n"))
        .withColumn("rounds", F.expr("(n + 1) div 2"))
        .select("dialogue_id", _dialogue_name(F.col("dialogue_id"), F.col("rounds")).alias("dialogue"), "rounds")
    )


CONFIG = (
    PAIRS
    + """, rounds AS (SELECT dialogue_id, (count(*) + 1) // 2 AS rounds FROM spoken GROUP BY 1), config AS (
  SELECT dialogue_id, rounds,
         CASE WHEN dialogue_id % 10 = 9 THEN ''
              WHEN dialogue_id % 10 = 7 THEN 'dialogue_c' || dialogue_id || '_x.txt'
              ELSE 'dialogue_c' || dialogue_id || '_' || rounds || '.txt' END AS dialogue,
         CASE WHEN dialogue_id % 10 IN (7, 9) THEN NULL ELSE rounds END AS named
  FROM rounds)"""
)


def score_text(value: Column, variant: Column) -> Column:
    """A score written the ways judges write it."""
    plain = value.cast("string")
    return (
        F.when(variant == 1, F.translate(plain, DIGITS, FULL_WIDTH_DIGITS))
        .when(variant == 2, F.concat(F.lit(" "), plain, F.lit(" ")))
        .when(variant == 3, F.concat(plain, F.lit("点")))
        .when(variant == 4, F.concat(plain, F.lit(".0")))
        .otherwise(plain)
    )


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tone and logic cells ``(dialogue_id, dialogue, pair_num, metric_type, score_text)``.

    Tone runs to 6, outside the scale.
    """
    variant = (F.col("dialogue_id") + F.col("pair_num")) % 6
    cells = F.array(
        F.struct(F.lit("tone").alias("metric_type"), score_text(F.col("assistant_len") % 7, variant).alias("score_text")),
        F.struct(
            F.lit("logic").alias("metric_type"),
            score_text((F.col("dialogue_id") + F.col("pair_num")) % 5, variant).alias("score_text"),
        ),
    )
    rows = pair_lengths(spark, sf_dir).select("dialogue_id", "pair_num", F.inline(cells))
    names = run_config(spark, sf_dir).select("dialogue_id", "dialogue")
    return rows.join(names, "dialogue_id")


SCORES = (
    CONFIG
    + """, cells AS (
  SELECT dialogue_id, pair_num, (dialogue_id + pair_num) % 6 AS variant, 'tone' AS metric_type,
         length(assistant_text) % 7 AS v FROM pairs
  UNION ALL
  SELECT dialogue_id, pair_num, (dialogue_id + pair_num) % 6, 'logic', (dialogue_id + pair_num) % 5 FROM pairs
), scores AS (
  SELECT c.dialogue_id, f.dialogue, f.named, pair_num, metric_type, variant, v,
         CASE WHEN variant IN (0, 1, 5) THEN v END AS raw_score,
         CASE WHEN variant IN (0, 1, 2, 5) THEN v END AS digit_score,
         CASE WHEN variant IN (0, 1, 2, 4, 5) THEN v END AS float_score,
         CASE WHEN variant IN (0, 2, 4, 5) THEN v END AS number_score,
         CASE variant WHEN 1 THEN translate(v::VARCHAR, '0123456789', '０１２３４５６７８９')
              WHEN 2 THEN ' ' || v || ' ' WHEN 3 THEN v || '点' WHEN 4 THEN v || '.0' ELSE v::VARCHAR END AS score_text
  FROM cells c JOIN config f USING (dialogue_id))"""
)


def run_log(events: DataFrame) -> DataFrame:
    """Events read as training-run log rows; works on a batch and on a stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("step"),
        F.when(kind != "signup", F.col("value")).alias("loss"),
        F.when(kind.isin("click", "view"), F.col("value") / 1000).alias("learning_rate"),
        (F.col("event_id") / 1000).alias("epoch"),
    )


RUN_LOG = """run_log AS (
  SELECT user_id AS run_id, ts, event_id AS step, CASE WHEN event_type <> 'signup' THEN value END AS loss,
         CASE WHEN event_type IN ('click', 'view') THEN value / 1000 END AS learning_rate, event_id / 1000 AS epoch
  FROM events)"""
