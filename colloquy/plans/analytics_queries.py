"""Rating analytics over ratings derived from ``conversations`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.scores import pair_penalty as penalty_of
from colloquy.operators import analytics as A
from colloquy.operators import ratings as R
from colloquy.operators import summaries as M
from colloquy.plans.inputs import CONFIG, RATINGS, SCORES, ratings, run_config, score_rows, table
from colloquy.plans.registry import query

_WITH = f"WITH {RATINGS} "


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    _WITH
    + """SELECT model_version, checkpoint, metric_type, round(avg(score), 6) AS mean,
       round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max, count(*) AS count
FROM ratings GROUP BY 1, 2, 3"""
)
def summary_stats(spark, sf_dir):
    return _round(A.summary_stats(ratings(spark, sf_dir), digits=None), "mean", "std")


def _merged_states(spark, sf_dir):
    """States of four loads, merged one after the other."""
    rated = ratings(spark, sf_dir)
    merged, *more = [M.summary_states(rated.filter(F.col("dialogue_id") % 4 == part)) for part in range(4)]
    for state in more:
        merged = M.merge_states(merged, state)
    return merged


@query(
    _WITH
    + """SELECT model_version, checkpoint, metric_type, round(avg(score), 6) AS mean,
       round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max, count(*) AS count
FROM ratings GROUP BY 1, 2, 3"""
)
def summary_of_loads(spark, sf_dir):
    """The same without the ratings of earlier loads."""
    return _round(M.summary_of_states(_merged_states(spark, sf_dir), digits=None), "mean", "std")


@query(
    _WITH
    + """SELECT model_version, checkpoint, metric_type, q::DOUBLE AS quantile, true AS within, count(score) AS n
FROM ratings, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) v(q) GROUP BY 1, 2, 3, 4"""
)
def quartiles_of_loads(spark, sf_dir):
    """Whether the sketched quartiles of all loads lie within the rank error among the ratings themselves."""
    found = M.quartiles_of_states(_merged_states(spark, sf_dir))
    counts = ratings(spark, sf_dir).groupBy(*M.GROUP, "score").agg(F.count("*").alias("_c"))
    ranked = found.join(counts, list(M.GROUP)).groupBy(*M.GROUP, "quantile", "n").agg(
        F.coalesce(F.sum(F.when(F.col("score") < F.col("value"), F.col("_c"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(F.col("score") <= F.col("value"), F.col("_c"))), F.lit(0)).alias("_through"),
    )
    low, high = F.col("_below") / F.col("n") - M.RANK_ERROR, F.col("_through") / F.col("n") + M.RANK_ERROR
    return ranked.select(*M.GROUP, "quantile", F.col("quantile").between(low, high).alias("within"), "n")


@query(
    _WITH
    + """, c AS (SELECT model_version, metric_type, grouping_id(model_version, metric_type) AS g, avg(score) AS mean,
  stddev_samp(score) AS std, count(score) AS n FROM ratings GROUP BY CUBE (model_version, metric_type))
SELECT c.model_version, c.metric_type, CASE c.g WHEN 0 THEN 'model_metric' WHEN 1 THEN 'model' WHEN 2 THEN 'metric' ELSE 'total' END AS level,
  round(c.mean, 6) AS mean, round(c.std, 6) AS std, c.n,
  CASE WHEN c.g < 2 AND c.model_version <> 'base' THEN round(c.mean - b.mean, 6) END AS improvement
FROM c LEFT JOIN c b ON b.g = c.g AND b.g < 2 AND b.model_version = 'base' AND b.metric_type IS NOT DISTINCT FROM c.metric_type"""
)
def rating_cube(spark, sf_dir):
    """Means, deviations and gains over the base by model and metric, by either and in total, from one scan."""
    return _round(M.rating_cube(ratings(spark, sf_dir)), "mean", "std", "improvement")


@query(
    """WITH l AS (SELECT doc_id, 'quality' AS metric_type, quality AS score FROM labels
                  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
SELECT source, lang, metric_type, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std,
       min(score)::DOUBLE AS min, max(score)::DOUBLE AS max, count(score) AS count
FROM l JOIN documents USING (doc_id) GROUP BY 1, 2, 3"""
)
def label_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "metric_type", "score")
    keyed = labels.withColumn("score", F.col("score").cast("double")).join(
        table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id"
    )
    return _round(A.summary_stats(keyed, "source", "lang", "metric_type", digits=None), "mean", "std")


@query(
    f"WITH {SCORES} "
    + """SELECT dialogue_id, CASE WHEN dialogue_id % 3 = 1 THEN 'tuned' ELSE 'base' END AS model_version,
       CASE WHEN dialogue_id % 3 = 1 THEN 'checkpoint-100' ELSE 'base' END AS checkpoint,
       metric_type || '_pair' || pair_num AS metric_pair, metric_type, pair_num,
       number_score::DOUBLE AS score
FROM scores WHERE number_score IS NOT NULL"""
)
def melt_ratings(spark, sf_dir):
    cells = score_rows(spark, sf_dir).withColumnRenamed("score_text", "score")
    tuned = F.col("dialogue_id") % 3 == 1
    wide = R.ratings_in_parts(cells, ["dialogue_id"], ("tone", "logic")).select(
        "*",
        F.when(tuned, "tuned").alias("model_version"),
        F.when(tuned, "checkpoint-100").alias("checkpoint"),
    )
    return A.melt_ratings(A.fill_default_keys(wide), ["dialogue_id", "model_version", "checkpoint"], part_width=2)


_EXPECTED = """, expected AS (SELECT coalesce(sum(named), 0)::BIGINT AS expected FROM config)
, counted AS (SELECT * FROM scores WHERE dialogue = '' OR named IS NOT NULL) """


@query(
    f"WITH {SCORES}"
    + _EXPECTED
    + """, valid AS (SELECT metric_type, count(raw_score) AS n_valid FROM counted GROUP BY 1)
, grid AS (SELECT m.metric_type, s.score FROM (VALUES ('tone'), ('logic')) m(metric_type),
           (VALUES (0), (1), (2), (3), (4)) s(score))
, found AS (SELECT metric_type, raw_score AS score, count(*) AS n FROM counted GROUP BY 1, 2)
SELECT metric_type, score, coalesce(n, 0) AS n,
       round(CASE WHEN coalesce(n_valid, 0) > 0 THEN coalesce(n, 0) / n_valid * 100 ELSE 0 END, 6) AS pct_valid,
       round(CASE WHEN expected > 0 THEN coalesce(n, 0) / expected * 100 ELSE 0 END, 6) AS pct_expected
FROM grid LEFT JOIN found USING (metric_type, score) LEFT JOIN valid USING (metric_type), expected"""
)
def score_distribution(spark, sf_dir):
    out = A.score_distribution(score_rows(spark, sf_dir), run_config(spark, sf_dir))
    return _round(out, "pct_valid", "pct_expected")


@query(
    f"WITH {SCORES}"
    + _EXPECTED
    + """SELECT metric_type, expected, count(raw_score) AS n_valid, expected - count(raw_score) AS n_missing,
       round((expected - count(raw_score)) / expected * 100, 6) AS pct_missing
FROM counted, expected GROUP BY metric_type, expected"""
)
def expected_and_missing(spark, sf_dir):
    return _round(A.expected_and_missing(score_rows(spark, sf_dir), run_config(spark, sf_dir)), "pct_missing")


_AVERAGES = """, averages AS (SELECT dialogue, named, avg(digit_score) AS avg_score, count(digit_score) AS n_scores
  FROM scores WHERE dialogue <> '' GROUP BY 1, 2) """


@query(f"WITH {SCORES}" + _AVERAGES + "SELECT dialogue, round(avg_score, 6) AS avg_score, n_scores FROM averages")
def dialogue_average(spark, sf_dir):
    return _round(A.dialogue_average(score_rows(spark, sf_dir)), "avg_score")


@query(
    f"WITH {SCORES}"
    + _AVERAGES
    + """SELECT dialogue, round(avg_score, 6) AS avg_score, n_scores,
       CASE WHEN avg_score <= 2 THEN 'low' WHEN avg_score IS NOT NULL THEN 'ok' ELSE 'unrated' END AS verdict
FROM averages WHERE dialogue IN (SELECT dialogue FROM config WHERE rounds > 1)"""
)
def low_rated_verdict(spark, sf_dir):
    files = run_config(spark, sf_dir).filter("rounds > 1")
    return _round(A.low_rated_verdict(A.dialogue_average(score_rows(spark, sf_dir)), files), "avg_score")


@query(
    f"WITH {SCORES}"
    + _AVERAGES
    + """SELECT dialogue, round(avg_score, 6) AS avg_score, n_scores, named AS expected_pairs, n_scores // 2 AS scored_pairs
FROM averages WHERE n_scores > 0 AND n_scores // 2 < named"""
)
def incomplete_dialogues(spark, sf_dir):
    return _round(A.incomplete_dialogues(A.dialogue_average(score_rows(spark, sf_dir))), "avg_score")


_DIFFS = """, means AS (SELECT model_version, checkpoint, metric_type, avg(score) AS mean,
    avg(score) FILTER (pair_num = 1) AS mean1, avg(score) FILTER (pair_num = 2) AS mean2, min(dialogue_id) AS seen
  FROM ratings GROUP BY 1, 2, 3)
, penalties AS (SELECT *, CASE WHEN mean1 > mean2 THEN -0.2::DOUBLE * (mean1 - mean2)
                               WHEN mean1 < mean2 THEN 0.1::DOUBLE * (mean2 - mean1)
                               WHEN mean1 = mean2 THEN 0 END AS penalty FROM means) """


@query(
    _WITH
    + _DIFFS
    + """SELECT model_version, checkpoint, metric_type, round(mean1 - mean2, 6) AS difference FROM means
WHERE mean1 IS NOT NULL AND mean2 IS NOT NULL"""
)
def pair_difference(spark, sf_dir):
    return _round(A.pair_difference(ratings(spark, sf_dir)), "difference")


@query(
    _WITH
    + _DIFFS
    + """SELECT model_version, checkpoint, metric_type, round(penalty, 6) AS penalty FROM penalties
WHERE penalty IS NOT NULL"""
)
def pair_penalty(spark, sf_dir):
    diffs = A.pair_difference(ratings(spark, sf_dir))
    return diffs.select(
        "model_version", "checkpoint", "metric_type", F.round(penalty_of(F.col("difference")), 6).alias("penalty")
    )


_SCORED = (
    _DIFFS
    + """, scored AS (SELECT model_version, checkpoint,
    0.85::DOUBLE * (max(mean) FILTER (metric_type = 'tone') * (0.35::DOUBLE / 0.85::DOUBLE)
      + max(mean) FILTER (metric_type = 'logic') * (0.20::DOUBLE / 0.85::DOUBLE)
      + max(mean) FILTER (metric_type = 'approach') * (0.20::DOUBLE / 0.85::DOUBLE)
      + max(mean) FILTER (metric_type = 'format') * (0.10::DOUBLE / 0.85::DOUBLE))
    + 0.15::DOUBLE * coalesce(avg(penalty), 0) AS final_score, min(seen) AS first_seen
  FROM penalties GROUP BY 1, 2)
, best AS (SELECT model_version, checkpoint, final_score FROM scored WHERE model_version <> 'base'
  QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY round(final_score, 9) DESC, first_seen) = 1)
, best_rows AS (SELECT * FROM ratings WHERE model_version = 'base'
  UNION ALL SELECT r.* FROM ratings r SEMI JOIN best b USING (model_version, checkpoint)) """
)


@query(
    _WITH + _SCORED + "SELECT model_version, checkpoint, round(final_score, 6) AS final_score, first_seen FROM scored"
)
def checkpoint_score(spark, sf_dir):
    return _round(A.checkpoint_score(ratings(spark, sf_dir)), "final_score")


@query(_WITH + _SCORED + "SELECT model_version, checkpoint, round(final_score, 6) AS final_score FROM best")
def best_checkpoint(spark, sf_dir):
    return _round(A.best_checkpoint(A.checkpoint_score(ratings(spark, sf_dir))), "final_score")


def _best_rows(spark, sf_dir):
    rated = ratings(spark, sf_dir)
    return A.best_checkpoint_rows(rated, A.best_checkpoint(A.checkpoint_score(rated)))


@query(
    _WITH + _SCORED + "SELECT dialogue_id, model_version, checkpoint, pair_num, metric_type, score FROM best_rows"
)
def best_checkpoint_rows(spark, sf_dir):
    return _best_rows(spark, sf_dir)


_QUARTILES = """quantile_cont(score, 0.0) AS min, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
  quantile_cont(score, 0.75) AS q3, quantile_cont(score, 1.0) AS max, count(*) AS n"""


@query(_WITH + _SCORED + f"SELECT model_version, metric_type, {_QUARTILES} FROM best_rows GROUP BY 1, 2")
def score_quartiles(spark, sf_dir):
    return A.score_quartiles(_best_rows(spark, sf_dir), "model_version", "metric_type")


@query(
    _WITH
    + """SELECT model_version,
  CASE WHEN checkpoint = 'base' THEN 0 ELSE replace(checkpoint, 'checkpoint-', '')::INT END AS checkpoint_num,
  round(avg(score) FILTER (metric_type = 'tone'), 6) AS tone,
  round(avg(score) FILTER (metric_type = 'approach'), 6) AS approach,
  round(avg(score) FILTER (metric_type = 'format'), 6) AS format,
  round(avg(score) FILTER (metric_type = 'logic'), 6) AS logic
FROM ratings GROUP BY 1, 2"""
)
def checkpoint_progression(spark, sf_dir):
    return _round(A.checkpoint_progression(ratings(spark, sf_dir)), "tone", "approach", "format", "logic")


_GAIN = """SELECT metric_type, t.model_version, round(t.mean, 6) AS mean, round(b.mean, 6) AS base_mean,
  round(t.mean - b.mean, 6) AS improvement
FROM m t LEFT JOIN (SELECT metric_type, mean FROM m WHERE model_version = 'base') b USING (metric_type)
WHERE t.model_version <> 'base'"""


@query(
    _WITH
    + _SCORED
    + ", m AS (SELECT model_version, metric_type, avg(score) AS mean FROM best_rows GROUP BY 1, 2) "
    + _GAIN
)
def improvement_from_base_best(spark, sf_dir):
    return _round(A.best_against_base(ratings(spark, sf_dir)), "mean", "base_mean", "improvement")


_MEANS = ", m AS (SELECT model_version, metric_type, avg(score) AS mean FROM ratings GROUP BY 1, 2) "


@query(_WITH + _MEANS + _GAIN)
def improvement_from_base_all(spark, sf_dir):
    return _round(A.improvement_from_base_all(ratings(spark, sf_dir)), "mean", "base_mean", "improvement")


@query(_WITH + _MEANS + "SELECT model_version, metric_type, round(mean, 6) AS mean FROM m")
def model_metric_means(spark, sf_dir):
    return _round(A.model_metric_means(ratings(spark, sf_dir)), "mean")


@query(
    _WITH
    + _MEANS
    + """SELECT model_version, metric_type, round(mean, 6) AS mean FROM m
QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY round(mean, 9) DESC, metric_type) = 1"""
)
def best_metric_per_model(spark, sf_dir):
    return _round(A.best_metric_per_model(ratings(spark, sf_dir)), "mean")


@query(_WITH + "SELECT model_version, metric_type, round(stddev_samp(score), 6) AS std FROM ratings GROUP BY 1, 2")
def stability(spark, sf_dir):
    return _round(A.stability(ratings(spark, sf_dir)), "std")


_GAIN_COLUMNS = "round({f}, 6) AS first_mean, round({l}, 6) AS last_mean, round({l} - {f}, 6) AS gain"


@query(
    _WITH
    + "SELECT model_version, metric_type, "
    + _GAIN_COLUMNS.format(
        f="avg(score) FILTER (checkpoint = 'checkpoint-100')", l="avg(score) FILTER (checkpoint = 'checkpoint-500')"
    )
    + " FROM ratings GROUP BY 1, 2"
)
def first_to_last_gain(spark, sf_dir):
    gains = A.first_to_last_gain(ratings(spark, sf_dir), "checkpoint-100", "checkpoint-500")
    return _round(gains, "first_mean", "last_mean", "gain")


@query(
    _WITH
    + """, c AS (SELECT model_version, metric_type, CASE WHEN checkpoint = 'base' THEN 0
          ELSE replace(checkpoint, 'checkpoint-', '')::INT END AS num, avg(score) AS mean FROM ratings GROUP BY 1, 2, 3)
SELECT model_version, metric_type, """
    + _GAIN_COLUMNS.format(f="arg_min(mean, num)", l="arg_max(mean, num)")
    + " FROM c GROUP BY 1, 2"
)
def own_first_to_last_gain(spark, sf_dir):
    gains = A.first_to_last_gain(ratings(spark, sf_dir), None, None)
    return _round(gains, "first_mean", "last_mean", "gain")


@query(
    f"WITH {CONFIG} SELECT dialogue, named AS turns FROM config"
)
def turns_from_name(spark, sf_dir):
    from colloquy.functions.names import turns_from_name as turns

    return run_config(spark, sf_dir).select("dialogue", turns(F.col("dialogue")).alias("turns"))
