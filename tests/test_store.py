"""The bucketed rating store: merges, repeats, failed loads, and which folders a load writes."""

import glob

import pytest
from pyspark.sql import functions as F

from colloquy.operators.ratings import upsert_ratings
from colloquy.sources.store import RatingStore

SCHEMA = "dialogue_id bigint, metric_type string, pair_num bigint, score double"


def loads(spark):
    first = [(d, m, p, float(d)) for d in range(40) for m in ("tone", "logic") for p in (1, 2)]
    second = [(3, "tone", 1, 9.0), (3, "tone", 2, None), (77, "tone", 1, 5.0), (None, "tone", 1, 1.0), (5, "logic", 9, None)]
    return spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("dialogue_id", "metric_type", "pair_num", "score").collect()), key=str)


def test_loads_merge_like_the_batch(spark, tmp_path):
    first, second = loads(spark)
    store = RatingStore(spark, str(tmp_path / "s"), buckets=8)
    assert store.load(first, "a", 1) and rows(store.read()) == rows(first)
    assert store.load(second, "a", 2) and not store.load(second, "a", 2) and not store.load(first, "a", 1)
    assert rows(store.read()) == rows(upsert_ratings(first, second))
    assert store.load(first, "b", 1)
    assert rows(RatingStore(spark, str(tmp_path / "s"), buckets=8).read()) == rows(upsert_ratings(upsert_ratings(first, second), first))


def test_a_load_rewrites_only_its_buckets(spark, tmp_path):
    first, second = loads(spark)
    store = RatingStore(spark, str(tmp_path / "s"), buckets=16)
    store.load(first, "a", 1)
    before = {r["bucket"]: r["folder"] for r in store.manifest()}
    store.load(second.filter("dialogue_id = 3"), "a", 2)
    after = store._folders(store.manifest())
    assert sum(after[b] != before[b] for b in before) == 1
    new = set(after.values()) - set(before.values())
    assert len(glob.glob(f"{tmp_path}/s/data/{new.pop()}/bucket=*")) == 1


def test_a_failed_load_leaves_the_old_version(spark, tmp_path, monkeypatch):
    first, second = loads(spark)
    store = RatingStore(spark, str(tmp_path / "s"), buckets=8)
    store.load(first, "a", 1)
    broken = second.withColumn("score", F.when(F.col("dialogue_id") == 77, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        store.load(broken, "a", 2)
    with monkeypatch.context() as patched:
        patched.setattr(RatingStore, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.load(second, "a", 2)
    assert rows(store.read()) == rows(first)
    assert store.load(second, "a", 2) and rows(store.read()) == rows(upsert_ratings(first, second))


def test_a_version_is_written_once(spark, tmp_path):
    first, second = loads(spark)
    store = RatingStore(spark, str(tmp_path / "s"), buckets=8)
    seen = store.manifest()
    store.load(first, "a", 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store._commit(seen, [(0, "x", "b", 1)])
    assert rows(store.read()) == rows(first)


def test_nothing_to_load(spark, tmp_path):
    store = RatingStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.read()
    assert store.load(loads(spark)[0].limit(0), "a", 1) and not store.load(loads(spark)[0], "a", 1)
