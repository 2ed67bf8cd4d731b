"""Positions, running sums and trailing windows across span borders, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import spans


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    hot = [("hot", o, rng.randint(0, 9)) for o in rng.sample(range(400), 150)]
    cold = [(f"k{k}", o, rng.randint(0, 9)) for k in range(20) for o in rng.sample(range(60), rng.randint(1, 6))]
    return hot + cold


def by_key(rows):
    groups = {}
    for key, order, value in sorted(rows):
        groups.setdefault(key, []).append((order, value))
    return groups


@pytest.mark.parametrize("span", [1, 3, 16, 65536])
def test_position_and_running_sum(spark, rows, span):
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    out = spans.with_position(df, ["k"], "o", "p", span)
    out = spans.running_sum(out, ["k"], "o", F.col("v"), "total", span)
    expected = set()
    for key, group in by_key(rows).items():
        total = 0
        for i, (order, value) in enumerate(group):
            total += value
            expected.add((key, order, value, i, total))
    assert {tuple(r) for r in out.select("k", "o", "v", "p", "total").collect()} == expected


@pytest.mark.parametrize("size", [1, 2, 5])
@pytest.mark.parametrize("span", [2, 7, 65536])
def test_trailing(spark, rows, size, span):
    dense = [(k, i, v) for k, group in by_key(rows).items() for i, (_, v) in enumerate(group)]
    df = spark.createDataFrame(dense, "k string, p bigint, v bigint").repartition(5)
    out = spans.trailing(df, ["k"], "p", size, lambda w: {"last": F.collect_list("v").over(w)}, span)
    groups = by_key(dense)
    expected = {(k, p, tuple(v for _, v in groups[k][max(0, p - size + 1) : p + 1])) for k, p, _ in dense}
    actual = [(r["k"], r["p"], tuple(r["last"])) for r in out.collect()]
    assert len(actual) == len(dense) and set(actual) == expected


def test_rows_without_key_stay(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), ("a", 4)], "k string, o bigint")
    out = {(r["k"], r["o"], r["p"]) for r in spans.with_position(df, ["k"], "o", "p").collect()}
    assert out == {(None, 0, None), (None, 1, None), ("a", 4, 0)}


def test_a_hot_key_is_shuffled_by_span(spark, rows):
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    plan = spans.with_position(df, ["k"], "o", "p", 16)._jdf.queryExecution().toString()
    assert "hashpartitioning(k#" in plan and "_span#" in plan


def test_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        spans.trailing(spark.range(1).withColumn("k", F.lit(1)), ["k"], "id", 0, lambda w: {})
