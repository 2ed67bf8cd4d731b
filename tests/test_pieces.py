"""Logs cut anywhere, against the readers of whole logs."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import pieces as P
from colloquy.operators import transcripts as X
from colloquy.sources import readers as S

MARK = X.LOG_MARKER
LOGS = [
    "",
    "no marker\nUser: a",
    f"{MARK}",
    f"head\n{MARK}\n\nUser: a\n\nAssistant: b\n\n",
    f"{MARK}\n  \n\t　User: indented first\nmore\n  User: not a turn but strict\nAssistant: x\n\n y \nAssistant: last\nUser: odd",
    f"{MARK}stray\nUser: a\r\nAssistant:\r\n  b  \r\r c\rUser:\rAssistant: d\r\n",
    f"User: before {MARK} User: same line\nUser: a {MARK} User: after\nAssistant: gone",
    f"{MARK}\nAssistant: first\nand on\nUser: u\nu2\nAssistant: a1\nAssistant:\n\n\nUser: v\nAssistant: w x　",
    f"{MARK}\nUser: a{MARK}{MARK}\nAssistant: b",
    f"{MARK}\n \n\n",
    f"{MARK}\nnoise\n  User: not first\nUser: yes\nAssistant: ok",
    f"{MARK}\nUser: " + "x" * 500 + "\n" + "line\n" * 50 + "Assistant: " + "y z " * 100,
]


def cut(rng, text):
    at = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.choice([0, 1, 3, 40]))))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    alphabet = [MARK, "User:", "Assistant:", "\n", "\r\n", "\r", " ", "　", "a", "b", "\n\n", "User: ", "\nAssistant: "]
    texts = LOGS + [MARK * rng.randrange(2) + "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(150)]
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "dialogue_id bigint, content string")
    rows = [(i, 7 * n, part) for i, t in enumerate(texts) for n, part in enumerate(cut(rng, t))]
    rows += [(0, 100, None)]
    rng.shuffle(rows)
    return whole, spark.createDataFrame(rows, "dialogue_id bigint, piece int, content string").repartition(5)


def test_turns(tables):
    whole, cut_up = tables
    want = X.explode_turns(X.with_turns(whole), "dialogue_id")
    got = P.turns_of_lines(P.log_lines(cut_up)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_pairs(tables):
    whole, cut_up = tables
    want = X.explode_pairs(X.with_pairs(whole), "dialogue_id")
    got = P.pairs_of_lines(P.log_lines(cut_up)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 30


def test_pieces_are_the_document(spark):
    turns = spark.createDataFrame([(d, t, "User" if t % 2 == 0 else "Assistant", f"said {t}\nmore") for d in (1, 2) for t in range(5 * d)], "dialogue_id bigint, turn bigint, speaker string, text string")
    whole = {r["dialogue_id"]: r["content"] for r in X.render_transcripts(turns).collect()}
    for size in (1, 3, 100):
        found = P.render_pieces(turns, piece_turns=size).collect()
        for d in (1, 2):
            assert "".join(r["content"] for r in sorted(found, key=lambda r: r["piece"]) if r["dialogue_id"] == d) == whole[d]
        assert len(found) == sum(-(-5 * d // size) for d in (1, 2))
    again = P.turns_of_lines(P.log_lines(P.render_pieces(turns, piece_turns=2)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, turns.collect()))


def test_empty_tables_and_null_keys(spark):
    empty = spark.createDataFrame([], "dialogue_id bigint, piece int, content string")
    assert P.turns_of_lines(P.log_lines(empty)).count() == 0 and P.pairs_of_lines(P.log_lines(empty)).count() == 0
    rows = [(None, 1, f"{MARK}\nUser: a\nAssis"), (None, 2, "tant: b"), (3, 1, None)]
    lines = P.log_lines(spark.createDataFrame(rows, "dialogue_id bigint, piece int, content string"))
    assert P.turns_of_lines(lines).orderBy("turn").select("speaker", "text").collect() == [("User", "a"), ("Assistant", "b")]


def test_a_file_in_many_splits(spark, tmp_path):
    """One log of some hundred kilobytes, read by many tasks."""
    text = f"head\r\n{MARK}\r\n" + "".join(f"{'User' if i % 2 == 0 else 'Assistant'}: turn {i}\r\n  more of {i}\r\n\r\n" for i in range(4000))
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "one.txt").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = S.read_log_lines(spark, str(tmp_path / "long"))
        assert lines.rdd.getNumPartitions() > 5
        turns = P.turns_of_lines(P.log_lines(lines, "file_name"), "file_name").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("one.txt", i, "User" if i % 2 == 0 else "Assistant", f"turn {i}\nmore of {i}") for i in range(4000)]
    assert sorted(map(tuple, turns)) == want


def test_no_group_holds_a_dialogue(spark):
    """Grouping is by (dialogue, line) or (dialogue, turn) and scans are by (dialogue, range)."""
    rows = spark.range(10).select(F.lit(1).alias("dialogue_id"), F.col("id").alias("piece"), F.lit("User: a\n").alias("content"))
    plan = P.turns_of_lines(P.log_lines(rows))._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "hashpartitioning(dialogue_id#" in line and line.count("#") == 2 and "_r" not in line]
    wide = [line for line in alone if "_text" in line or "_said" in line]
    assert not wide
