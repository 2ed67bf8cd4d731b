"""Prefix scans and trailing windows over sampled ranges, against brute force; how a hot key is dealt."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import scans

SCHEMA = "k string, o bigint, v bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    hot = [("hot", o * 10**9, rng.randint(0, 9)) for o in rng.sample(range(10**6), 900)]
    cold = [(f"k{k}", o, rng.randint(0, 9)) for k in range(60) for o in rng.sample(range(10**12), rng.randint(1, 9))]
    return hot + cold + [(None, 3, 4), (None, 8, 5)]


def by_key(rows):
    groups = {}
    for key, order, value in sorted(rows, key=str):
        groups.setdefault(key, []).append((order, value))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("ranges", [1, 37, None])
def test_running_sums(spark, rows, ranges):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = scans.running_sums(df, ["k"], "o", ranges, total=F.col("v"), odd=F.col("v") % 2)
    out = scans.with_position(out, ["k"], "o", "p", ranges)
    expected = set()
    for key, group in by_key(rows).items():
        total = odd = 0
        for i, (order, value) in enumerate(group):
            total, odd = total + value, odd + value % 2
            expected.add((key, order, value, total, odd, i))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == expected


@pytest.mark.parametrize("size, ranges", [(1, 9), (2, 37), (50, 9), (50, 1)])
def test_trailing(spark, rows, size, ranges):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = scans.trailing(df, ["k"], "o", size, lambda w: {"last": F.collect_list("v").over(w)}, ranges)
    expected = {
        (k, o, tuple(v for _, v in g[max(0, i - size + 1) : i + 1])) for k, g in by_key(rows).items() for i, (o, _) in enumerate(g)
    }
    got = [(r["k"], r["o"], tuple(r["last"])) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == expected


def test_order_of_any_type(spark):
    df = spark.createDataFrame([(1, 2, 0, 1), (1, 1, 5, 1), (1, 1, 3, 1)], "k int, a int, b int, v int")
    out = scans.with_position(df.withColumn("o", F.struct("a", "b")), ["k"], "o")
    assert {(r["a"], r["b"], r["position"]) for r in out.collect()} == {(1, 3, 0), (1, 5, 1), (2, 0, 2)}


def test_a_hot_key_is_dealt_evenly(spark):
    ranges = 16
    hot = spark.range(60_000).select(F.lit(1).alias("k"), (F.col("id") * F.col("id")).alias("o"))
    cold = spark.range(30_000).select((F.col("id") + 5).cast("int").alias("k"), F.xxhash64("id").alias("o"))
    dealt = scans.ranged(hot.unionByName(cold), ["k"], "o", ranges)
    of_hot = [r["n"] for r in dealt.filter("k = 1").groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(of_hot) >= 8 and max(of_hot) <= 2 * 90_000 / ranges
    assert dealt.filter("k > 1").groupBy("k").agg(F.max("_range").alias("m")).agg(F.max("m")).first()[0] <= 1


def test_rows_are_shuffled_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = scans.trailing(df, ["k"], "o", 10, lambda w: {"mean": F.avg("v").over(w)}, 37)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    by_range = [line for line in final.splitlines() if "Exchange hashpartitioning(k#" in line and "_range#" in line]
    assert by_range and all("Reused" in line for line in by_range[1:])


def test_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        scans.trailing(spark.range(1).withColumn("k", F.lit(1)), ["k"], "id", 0, lambda w: {})
