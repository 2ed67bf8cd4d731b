"""Registered queries on tables that also hold a very long dialogue, and one that the assistant opens."""

import os
from pathlib import Path

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as driver

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no driver tables")

QUERIES = (
    "split_sections format_pairs strip_parentheticals evaluated_transcripts transcript_headers chat_windows_from_transcripts "
    "prepared_examples flip_roles judge_request full_history open_judge_requests routed_transcripts pair_turns "
    "transcript_round_trip extract_pairs parse_two_metric_compact attach_ratings fully_rated parse_four_metric ratings_wide "
    "melt_ratings ratings_csv rate_answers stream_ratings rating_store scored_dialogue_documents segmented_round_trip"
).split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    for path in SF_DIR.iterdir():
        if path.name != "conversations.parquet":
            os.symlink(path, folder / path.name)
    old = spark.read.parquet(str(SF_DIR / "conversations.parquet"))
    turn = F.col("id")
    role = F.when(turn % 2 == 0, "user").otherwise("assistant")
    long = spark.range(1300).select(
        F.lit(900_001).cast("bigint").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.concat(F.lit("said "), turn).alias("text")
    )
    rows = old.unionByName(long).coalesce(1)
    rows.toPandas().to_parquet(folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    _, differences = compare(driver.queries()[name](spark, tables), duck(tables), driver.oracle_sql()[name])
    assert not differences, "\n".join(differences)
