"""Merged summaries against the batch, and the cube against its parts."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import analytics as A
from colloquy.operators import summaries as M

SCHEMA = "model_version string, checkpoint string, metric_type string, score double"


@pytest.fixture(scope="module")
def ratings(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["base", "m", None]), "c", rng.choice(["tone", "logic"]), rng.choice([None, 1e9 + rng.random(), 1e9 + 3])) for _ in range(4000)]
    rows += [("one", "c", "tone", 2.5), ("none", "c", "tone", None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("part", F.monotonically_increasing_id() % 7)


def by_group(df, *columns):
    return {tuple(r[k] for k in M.GROUP): tuple(r[c] for c in columns) for r in df.collect()}


def test_merged_states_equal_the_batch(ratings):
    merged = M.summary_states(ratings.filter("part = 0"))
    for part in range(1, 7):
        merged = M.merge_states(M.summary_states(ratings.filter(F.col("part") == part)), merged)
    columns = ("mean", "std", "min", "max", "count")
    got = by_group(M.summary_of_states(merged, digits=None), *columns)
    want = {g: v for g, v in by_group(A.summary_stats(ratings, digits=None), *columns).items() if v[4]}
    assert got.keys() == want.keys() and len(got) == 7
    for group, values in want.items():
        assert got[group][2:] == values[2:]
        for a, b in zip(got[group][:2], values[:2]):
            assert (a is None and b is None) or abs(a - b) <= 1e-9 * abs(b) + 1e-6


def test_all_states_at_once(ratings):
    parts = [M.summary_states(ratings.filter(F.col("part") == p)) for p in range(7)]
    one = by_group(M.merge_states(*parts), "n", "min", "max")
    assert one == by_group(M.summary_states(ratings), "n", "min", "max")


def test_quantiles_stay_within_their_rank(spark):
    n = 20_000
    rows = spark.range(n).select(*[F.lit("x").alias(k) for k in M.GROUP], (F.col("id") * 7919 % n).cast("double").alias("score"))
    merged = M.merge_states(*[M.summary_states(rows.filter(F.col("score") % 5 == i)) for i in range(5)])
    found = M.quartiles_of_states(merged, at=[0.01, 0.25, 0.5, 0.9, 1.0]).collect()
    assert len(found) == 5 and all(abs(r["value"] / n - r["quantile"]) <= M.RANK_ERROR + 1 / n and r["n"] == n for r in found)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    states = M.merge_states(M.summary_states(empty), M.summary_states(empty))
    assert M.summary_of_states(states).count() == M.quartiles_of_states(states).count() == 0
    assert M.rating_cube(empty).count() <= 1


def test_cube_equals_its_parts_from_one_scan(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["base", "a", "b"]), "c", rng.choice(["tone", "logic"]), float(rng.randrange(5))) for _ in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "r"))
    ratings = spark.read.parquet(str(tmp_path / "r"))
    cube = M.rating_cube(ratings)
    cells = {(r["model_version"], r["metric_type"]): r for r in cube.collect()}
    assert len(cells) == 12
    for r in A.model_metric_means(ratings).collect():
        assert cells[r["model_version"], r["metric_type"]]["mean"] == pytest.approx(r["mean"])
    for r in A.stability(ratings).collect():
        assert cells[r["model_version"], r["metric_type"]]["std"] == pytest.approx(r["std"])
    for r in A.improvement_from_base_all(ratings).collect():
        assert cells[r["model_version"], r["metric_type"]]["improvement"] == pytest.approx(r["improvement"])
    assert cells["a", None]["improvement"] == pytest.approx(cells["a", None]["mean"] - cells["base", None]["mean"])
    assert cells[None, None]["n"] == 300 and cells[None, "tone"]["improvement"] is None
    final = cube._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
