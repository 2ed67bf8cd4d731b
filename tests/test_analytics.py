"""Rating analytics: published summary where the table is at hand, and hand-made cases."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.functions.scores import coerce_score
from colloquy.operators import analytics as A
from colloquy.plans.jobs import rating_findings, rating_verdicts
from colloquy.sources.readers import read_ratings_wide

# Folder with a published rating table below config/ and its summary below analysis/.
GOLDEN = Path(os.environ.get("COLLOQUY_GOLDEN_DIR", "/nonexistent"))
RATING_TABLES = sorted(GOLDEN.glob("config/*.csv"))
SUMMARIES = sorted(GOLDEN.glob("analysis/*.csv"))
KEYS = ["model_version", "checkpoint", "metric_type"]
RATING = "dialogue_id int, model_version string, checkpoint string, metric_type string, pair_num int, score double"


def long_table(spark, *rows):
    return spark.createDataFrame(rows, RATING)


@pytest.fixture(scope="module")
def published(spark):
    if not RATING_TABLES or not SUMMARIES:
        pytest.skip("no published rating table")
    wide = A.fill_default_keys(read_ratings_wide(spark, str(RATING_TABLES[0])))
    return A.melt_ratings(wide, ["QUESTION_ID", "model_version", "checkpoint"])


def test_published_summary(spark, published):
    assert published.count() == 1760
    expected = spark.read.csv(str(SUMMARIES[0]), header=True)
    wanted = {
        tuple(r[k] for k in KEYS): tuple(float(r[c]) for c in ("mean", "std", "min", "max", "count"))
        for r in expected.collect()
    }
    found = {
        tuple(r[k] for k in KEYS): tuple(float(r[c]) for c in ("mean", "std", "min", "max", "count"))
        for r in A.summary_stats(published).collect()
    }
    assert len(wanted) == 44 and found == wanted


def test_published_best_checkpoints(published):
    scored = A.checkpoint_score(published, "QUESTION_ID")
    final = {r["model_version"]: r for r in A.best_checkpoint(scored).collect()}
    assert final["attention-tuned"]["checkpoint"] == "checkpoint-990"
    assert final["attention-tuned"]["final_score"] == pytest.approx(3.067375, abs=1e-9)
    assert final["standard-tuned"]["checkpoint"] == "checkpoint-300"
    assert final["standard-tuned"]["final_score"] == pytest.approx(2.839375, abs=1e-9)
    base = scored.filter("model_version = 'base'").first()
    assert base["final_score"] == pytest.approx(2.52975, abs=1e-9)


def test_findings(published):
    f = rating_findings(published, "QUESTION_ID")
    assert f.summary.count() == 44 and f.best.count() == 2 and f.progression.count() == 11
    assert f.first_to_last.filter("gain is not null").count() == 8
    assert f.quartiles.filter("n = 40").count() == 12 and f.means.count() == 12
    assert {r["metric_type"] for r in f.gain_over_base.collect()} == {"tone", "approach", "format", "logic"}


def test_score_rules(spark):
    texts = ["3", "3.0", " 3 ", "３", "4点", "nan", "7", "", None, "3d", "-1", "1e1", ".5", "0x1", "３.5", "+2", "inf", "　２　"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rules = ("float", "digits", "digits_raw", "numeric")
    rows = {r["i"]: r for r in df.select("i", *[coerce_score(F.col("t"), r).alias(r) for r in rules]).collect()}
    got = {t: tuple(rows[i][r] for r in rules) for i, t in enumerate(texts)}
    assert got["3"] == (3, 3, 3, 3) and got["3.0"] == (3, None, None, 3) and got[" 3 "] == (3, 3, None, 3)
    assert got["３"] == (3, 3, 3, None) and got["　２　"] == (2, 2, None, None) and got["３.5"] == (3.5, None, None, None)
    assert got["-1"] == (-1, None, None, -1) and got["1e1"] == (10, None, None, 10) and got[".5"] == (0.5, None, None, 0.5)
    assert got["+2"] == (2, None, None, 2) and got["7"] == (7, 7, 7, 7)
    for text in ("4点", "nan", "", None, "3d", "0x1", "inf"):
        assert got[text] == (None, None, None, None)
    with pytest.raises(ValueError):
        coerce_score(F.col("t"), "other")


def test_melt(spark):
    wide = spark.createDataFrame(
        [(1, None, None, "3", "x", "4"), (2, "m", "checkpoint-1", None, "2", "NA")],
        "id int, model_version string, checkpoint string, tone_pair1 string, logic_pair2 string, tone_note string",
    )
    rows = A.melt_ratings(A.fill_default_keys(wide), ["id", "model_version", "checkpoint"]).collect()
    assert sorted((r["id"], r["model_version"], r["metric_type"], r["pair_num"], r["score"]) for r in rows) == [
        (1, "base", "tone", 1, 3.0), (2, "m", "logic", 2, 2.0),
    ]
    with pytest.raises(ValueError):
        A.melt_ratings(wide.select("id", "model_version"), ["id", "model_version"])


def test_distribution_and_missing(spark):
    config = spark.createDataFrame([("a_2.txt",), ("b_x.txt",), ("",), ("c_1.txt",)], "dialogue string")
    scores = spark.createDataFrame(
        [("a_2.txt", "tone", "3"), ("a_2.txt", "tone", "9"), ("b_x.txt", "tone", "3"), ("", "tone", "0"), ("c_1.txt", "logic", " 1 ")],
        "dialogue string, metric_type string, score_text string",
    )
    dist = {(r["metric_type"], r["score"]): r for r in A.score_distribution(scores, config).collect()}
    assert len(dist) == 10 and dist["tone", 3]["n"] == 1 and dist["tone", 0]["n"] == 1
    assert dist["tone", 3]["pct_valid"] == pytest.approx(100 / 3) and dist["tone", 3]["pct_expected"] == pytest.approx(100 / 3)
    assert dist["logic", 1]["n"] == 0 and dist["logic", 1]["pct_valid"] == 0
    missing = {r["metric_type"]: r for r in A.expected_and_missing(scores, config).collect()}
    assert (missing["tone"]["expected"], missing["tone"]["n_missing"], missing["logic"]["n_missing"]) == (3, 0, 3)
    nothing = A.expected_and_missing(scores, config.filter("dialogue = ''")).collect()
    assert all(r["pct_missing"] is None for r in nothing)


def test_verdicts(spark):
    scores = spark.createDataFrame(
        [("a_1.txt", "tone", "2"), ("a_1.txt", "logic", "２"), ("b_2.txt", "tone", "3"), ("c_1.txt", "tone", "x"),
         ("gone_1.txt", "tone", "1"), ("", "tone", "1"), ("b_2.txt", "format", "0")],
        "dialogue string, metric_type string, score_text string",
    )
    files = spark.createDataFrame([("a_1.txt",), ("b_2.txt",), ("c_1.txt",)], "dialogue string")
    verdicts = {r["dialogue"]: r["verdict"] for r in rating_verdicts(scores, files).collect()}
    assert verdicts == {"a_1.txt": "low", "b_2.txt": "ok", "c_1.txt": "unrated"}
    incomplete = A.incomplete_dialogues(A.dialogue_average(scores)).collect()
    assert [(r["dialogue"], r["scored_pairs"]) for r in incomplete if r["dialogue"] != "gone_1.txt"] == [("b_2.txt", 0)]


def test_checkpoint_score_ties_and_missing_metric(spark):
    def checkpoint(dialogue, name, tone=3.0, metrics=("tone", "approach", "format", "logic")):
        return [(dialogue, "m", name, k, 1, tone) for k in metrics]

    rows = [*checkpoint(2, "checkpoint-100"), *checkpoint(1, "checkpoint-200"), *checkpoint(0, "checkpoint-300", 4.0, ("tone", "logic"))]
    scored = A.checkpoint_score(long_table(spark, *rows))
    final = {r["checkpoint"]: r["final_score"] for r in scored.collect()}
    assert final["checkpoint-300"] is None
    assert final["checkpoint-100"] == final["checkpoint-200"] == pytest.approx(3.0 * 0.85)
    assert A.best_checkpoint(scored).first()["checkpoint"] == "checkpoint-200"
    with pytest.raises(Exception, match="lacks a metric"):
        A.checkpoint_score(long_table(spark, *rows), strict=True).collect()


def test_penalty_and_difference(spark):
    rows = [(1, "m", "c", "tone", 1, 4.0), (1, "m", "c", "tone", 2, 3.0), (1, "m", "c", "logic", 1, 1.0),
            (1, "m", "c", "logic", 2, 3.0), (1, "m", "c", "format", 1, 2.0)]
    ratings = long_table(spark, *rows)
    diffs = {r["metric_type"]: r["difference"] for r in A.pair_difference(ratings).collect()}
    assert diffs == {"tone": 1.0, "logic": -2.0}
    from colloquy.functions.scores import pair_penalty

    df = spark.createDataFrame([(1.0,), (-2.0,), (0.0,), (None,)], "d double")
    assert [r[0] for r in df.select(pair_penalty(F.col("d"))).collect()] == [-0.2, 0.2, 0.0, None]


def test_quartiles_are_exact_on_a_skewed_group(spark):
    rows = [(i, "m", "c", "tone", 1, float(i % 5)) for i in range(1001)] + [(1, "n", "c", "tone", 1, 2.0)]
    out = {r["model_version"]: r for r in A.score_quartiles(long_table(spark, *rows), "model_version").collect()}
    import numpy as np

    expected = np.quantile([i % 5 for i in range(1001)], [0, 0.25, 0.5, 0.75, 1])
    assert [out["m"][c] for c in ("min", "q1", "median", "q3", "max")] == list(expected) and out["m"]["n"] == 1001


def test_ties_of_best_metric(spark):
    rows = [(1, "m", "c", k, 1, 3.0) for k in ("tone", "approach", "logic")]
    assert A.best_metric_per_model(long_table(spark, *rows)).first()["metric_type"] == "approach"
