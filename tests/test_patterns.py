"""Tables of patterns against a search for each, in texts with and without sentence marks."""

import random

import pytest
from pyspark.sql import functions as F
from test_examples import brute_mask

from colloquy.operators import patterns as K


def texts_of(rng):
    words = ["かね", "だろうか", "では", "猫", "word", " ", "。", "。。", "ではないかね", "a", "ab", "aba", "𝄞", "é"]
    return ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "ab" * 700, "。".join("abaab" * 20 for _ in range(9))]


PATTERNS = ["かね", "では", "ではないかね", "a", "ab", "aba", "abaab", "wor", "dword", "𝄞", "é", "猫では", "nothing", "", None, "ab", "ba" * 40]


@pytest.fixture(scope="module")
def tables(spark):
    texts = texts_of(random.Random(7))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, text string").repartition(4)
    return texts, df, spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


def test_places(tables):
    texts, df, patterns = tables
    want = {(i, p, at) for i, t in enumerate(texts) for p in set(filter(None, PATTERNS)) for at in range(len(t)) if t.startswith(p, at)}
    got = [tuple(r) for r in K.pattern_places(df, patterns, ["i"], "text").select("i", "pattern", "at").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hits(tables):
    texts, df, patterns = tables
    for end in ("。", "a"):
        want = {}
        for p in set(filter(None, PATTERNS)):
            per = [sum(p in s for s in t.split(end) if s.strip()) for t in texts]
            want[p] = (sum(per), sum(n > 0 for n in per))
        found = K.table_hits(df, patterns, ["i"], end=end).collect()
        assert {r["pattern"]: (r["n_sentences"], r["n_rows"]) for r in found} == want


@pytest.mark.parametrize("anchor", ["tail", "actual"])
def test_mask(tables, anchor):
    texts, df, patterns = tables
    masked = df.withColumn("attention_mask", F.array_repeat(F.lit(0), 24))
    out = {r["i"]: r["attention_mask"] for r in K.table_span_mask(masked, patterns, ["i"], anchor=anchor).collect()}
    for i, text in enumerate(texts):
        assert out[i] == brute_mask(text, [0] * 24, list(filter(None, PATTERNS)), "。", anchor), text
    assert out[999] == [1] + [0] * 22 + [1]
    with pytest.raises(ValueError):
        K.table_span_mask(masked, patterns, ["i"], anchor="middle")


def test_ten_thousand_patterns_and_none(spark, tables):
    texts, df, _ = tables
    many = spark.range(10_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("pattern")).union(spark.createDataFrame([("aba",)], "pattern string"))
    found = {r["pattern"]: r["n_rows"] for r in K.table_hits(df, many, ["i"]).collect()}
    assert len(found) == 10_001 and found["aba"] == sum(any("aba" in s for s in t.split("。")) for t in texts) and found["w1"] == 0
    assert K.pattern_places(df, many.limit(0), ["i"], "text").count() == 0
