"""Judge answers rendered from derived scores, parsed again, and the rating store."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.plan import exploded
from colloquy.functions.scores import coerce_score as coerce
from colloquy.operators import ratings as R
from colloquy.operators import transcripts as X

from colloquy.plans import jobs
from colloquy.plans.inputs import RATINGS, SCORES, pair_lengths, rating_pairs, ratings, score_rows, table
from colloquy.plans.registry import query
from colloquy.plans.transcript_queries import documents_of
from colloquy.schemas import METRICS
from colloquy.session import shared_path
from colloquy.sources.store import RatingStore
from colloquy.sources.writers import append_rating_load, compact_rating_store, current_ratings

# A pair lacks its logic score where this holds.
GAP = "(dialogue_id + 2 * pair_num) % 7 = 3"


def _answer_blocks(rows, *block):
    """Answers ``(dialogue_id, answer)`` from one text block per pair; an answer covers its dialogue."""
    return (
        rows.groupBy("dialogue_id")
        .agg(F.array_sort(F.collect_list(F.struct("pair_num", F.concat(*block).alias("b")))).alias("_b"))
        .select("dialogue_id", F.array_join(F.transform("_b", lambda b: b["b"]), "\n").alias("answer"))
    )


def _four_metric(spark, sf_dir):
    parsed = R.parse_four_metric(four_metric_answers(spark, sf_dir), "dialogue_id")
    return parsed.withColumn("pair_num", F.col("pair_num").cast("bigint"))


def two_metric_answers(spark, sf_dir):
    tone, logic = F.col("tone").cast("string"), F.col("logic").cast("string")
    number = F.col("pair_num").cast("string")
    return _answer_blocks(
        rating_pairs(spark, sf_dir),
        F.lit("　【ペア"), number, F.lit("】\n口調：　"), tone, F.lit(" ：second\n"),
        F.when(F.expr(GAP), "").otherwise(F.concat(F.lit("論理性："), logic, F.lit("\n"))),
        F.lit("コメント：fine：really\n"),
    )


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, pair_num, metric_type, score::BIGINT::VARCHAR AS quantitative
FROM ratings WHERE metric_type IN ('tone', 'logic') AND NOT {GAP}"""
)
def parse_two_metric(spark, sf_dir):
    return R.parse_two_metric(two_metric_answers(spark, sf_dir), "dialogue_id")


@query(
    f"""WITH {RATINGS}, c AS (SELECT dialogue_id, metric_type, score, row_number()
    OVER (PARTITION BY dialogue_id, metric_type ORDER BY pair_num) AS pair_num
  FROM ratings WHERE metric_type IN ('tone', 'logic') AND NOT {GAP})
SELECT dialogue_id, pair_num, metric_type, score::BIGINT::VARCHAR AS quantitative FROM c"""
)
def parse_two_metric_compact(spark, sf_dir):
    return R.parse_two_metric(two_metric_answers(spark, sf_dir), "dialogue_id", compact=True)


def four_metric_answers(spark, sf_dir):
    number = F.col("pair_num").cast("string")
    block = [F.lit("【ペア"), number, F.lit("】\n")]
    for metric in METRICS:
        block += [
            F.lit(f"{R.CATEGORY_LABELS[metric]}\n"),
            F.when(F.expr(GAP) & F.lit(metric == "format"), "").otherwise(
                F.concat(F.lit("スコア："), F.col(metric).cast("string"), F.lit("\n"))
            ),
            F.lit("コメント："), F.lit(f"{metric} of "), number, F.lit("：cut off\n\n"),
        ]
    return _answer_blocks(rating_pairs(spark, sf_dir), *block)


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, pair_num, metric_type,
  CASE WHEN metric_type = 'format' AND {GAP} THEN '' ELSE score::BIGINT::VARCHAR END AS quantitative,
  metric_type || ' of ' || pair_num AS qualitative FROM ratings"""
)
def parse_four_metric(spark, sf_dir):
    return _four_metric(spark, sf_dir)


@query(
    f"""WITH {RATINGS} SELECT p.dialogue_id, p.pair_num, length(p.user_text) AS n_user, r.metric_type, r.score
FROM pairs p LEFT JOIN (SELECT * FROM ratings WHERE NOT {GAP}) r USING (dialogue_id, pair_num)"""
)
def join_ratings(spark, sf_dir):
    pairs = pair_lengths(spark, sf_dir).select("dialogue_id", "pair_num", F.col("user_len").alias("n_user"))
    long = ratings(spark, sf_dir).filter(~F.expr(GAP)).select("dialogue_id", "pair_num", "metric_type", "score")
    return R.join_ratings(pairs, long, "dialogue_id", "pair_num")


@query(
    f"""WITH {RATINGS}, n AS (SELECT dialogue_id, max(pair_num) - dialogue_id % 2 AS n_rated FROM pairs GROUP BY 1)
SELECT dialogue_id, pair_num, 'Assistant: ' || replace(assistant_text, chr(10), ' ') AS answer, tone::VARCHAR AS rating
FROM pairs JOIN n USING (dialogue_id)
  JOIN rating_pairs USING (dialogue_id, pair_num) WHERE pair_num <= n_rated"""
)
def attach_ratings(spark, sf_dir):
    """Pairs of each dialogue zipped with its tone scores; odd dialogues lack the last score."""
    pairs = X.with_pairs(documents_of(spark, sf_dir)).select("dialogue_id", "pairs")
    tone = R.parse_four_metric(four_metric_answers(spark, sf_dir), "dialogue_id").filter("metric_type = 'tone'")
    scores = tone.groupBy("dialogue_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pair_num", "quantitative"))), lambda r: r["quantitative"]
        ).alias("r")
    )
    short = F.slice("r", 1, F.greatest(F.size("r") - (F.col("dialogue_id") % 2).cast("int"), F.lit(0)))
    zipped = pairs.join(scores, "dialogue_id").withColumn("z", R.attach_ratings(F.col("pairs"), short))
    return exploded(zipped, "z", "dialogue_id").select(
        "dialogue_id",
        (F.col("_pos") + 1).cast("bigint").alias("pair_num"),
        F.col("_item.pair.assistant").alias("answer"),
        F.col("_item.rating").alias("rating"),
    )


@query(
    f"""WITH {SCORES} SELECT dialogue_id, pair_num, metric_type, float_score::DOUBLE AS by_float, digit_score::DOUBLE AS by_digits,
  raw_score::DOUBLE AS by_raw_digits, number_score::DOUBLE AS by_number FROM scores"""
)
def coerce_score(spark, sf_dir):
    cell = F.col("score_text")
    return score_rows(spark, sf_dir).select(
        "dialogue_id",
        "pair_num",
        "metric_type",
        coerce(cell, "float").alias("by_float"),
        coerce(cell, "digits").alias("by_digits"),
        coerce(cell, "digits_raw").alias("by_raw_digits"),
        coerce(cell, "numeric").alias("by_number"),
    )


def _loads(spark, sf_dir):
    """A first load, and a second one that corrects part of it and adds the rest."""
    rated = ratings(spark, sf_dir).select("dialogue_id", "metric_type", "pair_num", "score")
    first = rated.filter("dialogue_id % 3 <> 2")
    score = F.when(F.col("pair_num") % 4 != 3, F.col("score") + 1)
    second = rated.filter("dialogue_id % 2 = 0 or dialogue_id % 3 = 2").withColumn("score", score)
    return first, second


_UPSERTED = """upserted AS (SELECT dialogue_id, metric_type, pair_num,
    CASE WHEN (dialogue_id % 2 = 0 OR dialogue_id % 3 = 2) AND pair_num % 4 <> 3 THEN score + 1
         WHEN dialogue_id % 3 <> 2 THEN score END AS score FROM ratings)"""


@query(f"WITH {RATINGS}, {_UPSERTED} SELECT * FROM upserted")
def upsert_ratings(spark, sf_dir):
    return R.upsert_ratings(*_loads(spark, sf_dir))


@query(f"WITH {RATINGS}, {_UPSERTED} SELECT * FROM upserted")
def rating_store(spark, sf_dir):
    """The same through the store on disk: two loads, one of them written twice, then compacted."""
    first, second = _loads(spark, sf_dir)
    path, compact = shared_path(spark, "ratings"), shared_path(spark, "ratings-compact")
    append_rating_load(first, path, 0)
    append_rating_load(second, path, 1)
    append_rating_load(second, path, 1)
    compact_rating_store(spark, path, compact, 1)
    return current_ratings(spark, compact)


@query(f"WITH {RATINGS}, {_UPSERTED} SELECT * FROM upserted")
def bucketed_store(spark, sf_dir):
    """The same through buckets and a manifest: a load rewrites the buckets it touches, one that comes twice nothing."""
    first, second = _loads(spark, sf_dir)
    store = RatingStore(spark, shared_path(spark, "bucketed"), buckets=16)
    store.load(first, "batch", 0)
    store.load(second, "batch", 1)
    store.load(second, "batch", 1)
    return store.read()


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, model_version, checkpoint, metric_type || '_pair' || pair_num AS metric_pair, score
FROM ratings WHERE score IS NOT NULL"""
)
def ratings_wide(spark, sf_dir):
    """The wide table with columns for all pairs there are; its filled cells, as its width follows the data."""
    keys = ["dialogue_id", "model_version", "checkpoint"]
    wide = R.ratings_wide(ratings(spark, sf_dir), keys)
    cells = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, cells, "metric_pair", "score").filter("score is not null")


_PARTS = ", ".join(
    f"max(score) FILTER (metric_type = '{m}' AND (pair_num - 1) % 4 = {n - 1}) AS {m}_pair{n}"
    for n in (1, 2, 3, 4)
    for m in METRICS
)


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, model_version, checkpoint, (pair_num - 1) // 4 AS part, {_PARTS}
FROM ratings GROUP BY 1, 2, 3, 4"""
)
def ratings_in_parts(spark, sf_dir):
    """Wide rows of all pairs, four to a part, for tables whose width must not follow the longest dialogue."""
    keys = ["dialogue_id", "model_version", "checkpoint"]
    return R.ratings_in_parts(ratings(spark, sf_dir), keys, width=4)


@query(
    f"WITH {RATINGS} SELECT dialogue_id, bool_and(NOT {GAP}) AS fully_rated FROM pairs GROUP BY 1"
)
def fully_rated(spark, sf_dir):
    """Whether every pair of an answer has all four scores."""
    parsed = R.parse_four_metric(four_metric_answers(spark, sf_dir), "dialogue_id")
    verdict = F.struct("quantitative", "qualitative")
    per_pair = parsed.groupBy("dialogue_id", "pair_num").agg(
        F.struct(*[F.max(F.when(F.col("metric_type") == m, verdict)).alias(m) for m in METRICS]).alias("evaluation")
    )
    documents = per_pair.groupBy("dialogue_id").agg(
        F.collect_list(F.struct("pair_num", "evaluation")).alias("pairs")
    )
    return documents.select("dialogue_id", R.is_fully_rated(F.col("pairs")).alias("fully_rated"))


@query(
    """SELECT doc_id FROM documents WHERE NOT EXISTS
  (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)"""
)
def unrated_files(spark, sf_dir):
    store = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "1").otherwise(" ").alias("score")
    )
    return R.unrated_files(table(spark, sf_dir, "documents").select("doc_id"), store, "doc_id")


@query(
    f"""WITH {RATINGS} SELECT DISTINCT dialogue_id FROM ratings
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = ratings.dialogue_id)"""
)
def unknown_files(spark, sf_dir):
    config = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dialogue_id"))
    return R.unknown_files(ratings(spark, sf_dir), config)


@query(
    f"""WITH {RATINGS} SELECT dialogue_id, metric_type, pair_num,
  CASE WHEN dialogue_id % 2 = 0 AND dialogue_id % 5 <> 0 THEN score ELSE 9 END AS score FROM ratings
WHERE dialogue_id % 2 = 1 OR dialogue_id % 5 = 0 OR (metric_type IN ('tone', 'logic') AND NOT {GAP})"""
)
def rate_answers(spark, sf_dir):
    """Store of old scores, all 9, after a batch of answers for even dialogues; every fifth one is not in the config."""
    rated = ratings(spark, sf_dir)
    store = rated.select("dialogue_id", "metric_type", "pair_num", F.lit(9.0).alias("score"))
    config = rated.select("dialogue_id").filter("dialogue_id % 5 <> 0")
    return jobs.rate_answers(store, two_metric_answers(spark, sf_dir).filter("dialogue_id % 2 = 0"), config)
