"""Parsing rules of transcripts, by hand and against brute force on generated logs."""

import random

from pyspark.sql import functions as F

from colloquy.functions import names as N
from colloquy.functions.text import py_strip
from colloquy.operators import transcripts as X

MARK = X.LOG_MARKER
WIDE = "　"


def turns_of(one, content):
    parsed = one(X.parse_turns(X.split_sections(F.col("c"))["log"]), c=content)
    return None if parsed is None else [(t["speaker"], t["text"]) for t in parsed]


def pairs_of(one, log):
    return [(p["user"], p["assistant"]) for p in one(X.extract_pairs(F.col("c")), c=log)]


def test_turns_lenient(one):
    log = (
        f"preamble\nUser: {WIDE}hello{WIDE}\n  more \n\nError: lost\nAssistant:\nlate start\n"
        "say User: not a turn\n User: indented\nAssistant: b c\nUser:"
    )
    assert turns_of(one, f"head\n{MARK}\n\n{log}") == [
        ("User", "hello\nmore\nError: lost"),
        ("Assistant", "\nlate start\nsay User: not a turn\nUser: indented"),
        ("Assistant", "b c"),
        ("User", ""),
    ]


def test_no_marker_and_two_markers(one):
    assert turns_of(one, "User: a") is None
    assert turns_of(one, f"x{MARK}\nUser: a\n{MARK}\nUser: b") == [("User", "a")]


def test_sections(one):
    content = f"{X.EVALUATION_MARKER}\nfine\n\nhead\n{MARK}\n\nUser: a\n"
    s = one(X.split_sections(F.col("c")), c=content)
    assert (s["evaluation"], s["log"]) == ("fine\n\nhead", "User: a")
    assert one(X.is_evaluated(F.col("c")), c=f" {X.EVALUATION_MARKER}{WIDE}\nx") is True
    assert one(X.is_evaluated(F.col("c")), c=f"x\n{X.EVALUATION_MARKER}") is False
    assert one(X.embedded_evaluation(F.col("c")), c="nothing") is None
    assert one(X.attach_evaluation(F.col("c"), F.lit("e")), c="t") == f"{X.EVALUATION_MARKER}\ne\n\nt"


def test_pairs_strict(one):
    log = (
        "Assistant: first, no user yet\nUser: a\nuser continuation\nAssistant: x\n  y \n\n"
        f"Assistant: z\nz2\n{WIDE}User: b\nUser: c\nAssistant: w\nUser: tail"
    )
    assert pairs_of(one, log) == [("User: a", "Assistant: z z2"), ("User: c", "Assistant: w")]
    assert pairs_of(one, "nothing here") == []


def strict_pairs(log):
    """Line by line, written for this test."""
    pairs, user, answer = [], None, None
    for line in (x.strip() for x in log.strip().split("\n")):
        if not line:
            continue
        if line.startswith("User:"):
            if user is not None and answer is not None:
                pairs.append((user, answer))
            user, answer = line, None
        elif line.startswith("Assistant:"):
            answer = line
        elif answer is not None:
            answer = f"{answer} {line}"
    return pairs + ([(user, answer)] if user is not None and answer is not None else [])


def lenient_turns(log):
    turns = []
    for line in log.strip().split("\n"):
        speaker = next((s for s in ("User", "Assistant") if line.startswith(f"{s}:")), None)
        if speaker:
            turns.append([speaker, [line[len(speaker) + 1 :].strip()]])
        elif line.strip() and turns:
            turns[-1][1].append(line.strip())
    return [(s, "\n".join(t)) for s, t in turns]


def test_generated_logs_match_brute_force(spark):
    rng = random.Random(11)
    atoms = [
        "User: hi", "Assistant: yes", " User: pad", f"{WIDE}Assistant: pad", "User:", "Assistant:", "text", "  text ",
        "", f"{WIDE}", "Error: x", "a User: b", "x User: y", "t\x1c", "\x1fUser: z", "line ", "Assistant:User:",
    ]
    logs = ["\n".join(rng.choice(atoms) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, log string")
    for r in df.select("i", X.parse_turns(F.col("log")).alias("t"), X.extract_pairs(F.col("log")).alias("p")).collect():
        log = logs[r["i"]]
        assert [tuple(t) for t in r["t"]] == lenient_turns(log), repr(log)
        assert [tuple(p) for p in r["p"]] == strict_pairs(log), repr(log)


def test_pair_turns_drops_topic_and_tail(spark):
    def pairs(texts):
        df = spark.createDataFrame([([("s", t) for t in texts],)], "turns array<struct<speaker string, text string>>")
        return [tuple(p) for p in df.select(X.pair_turns(F.col("turns")).alias("p")).first()["p"]]

    assert pairs([]) == [] and pairs(["topic"]) == [] and pairs(["topic", "a"]) == []
    assert pairs(["topic", "a", "b", "c"]) == [(1, "a", "b")]
    assert pairs(["topic", "a", "b", "c", "d"]) == [(1, "a", "b"), (2, "c", "d")]


def test_parentheticals(one):
    strip = X.strip_parentheticals(F.col("c"))
    assert one(strip, c=f"（h）{MARK}a（b\n（c）d（e") == f"（h）{MARK}ad（e"
    assert one(strip, c=f"{MARK}（a）{MARK}") == f"{MARK}（a）{MARK}"
    assert one(strip, c="（a）") == "（a）"


def test_py_strip(one):
    padding = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    for text in (f"{padding}a b{padding}", f"{WIDE}\n{WIDE}", "a​", "", " a\n"):
        assert one(py_strip(F.col("c")), c=text) == text.strip()


def test_names(one):
    cases = {"dialogue_a_1_2_7.txt": 7, "x_y.z": None, "12.txt": 12, "": None, "a_3.5.txt": 3, "a_+4.b": 4}
    for name, turns in cases.items():
        assert one(N.turns_from_name(F.col("c")), c=name) == turns
    ids = N.artifact_ids(F.col("c"))
    assert tuple(one(ids, c="/r/models/tuned/model/checkpoint-300")) == ("tuned", "checkpoint-300")
    assert tuple(one(ids, c="/r/models")) == ("base", "base")
    assert tuple(one(ids, c="checkpoint-1/models/m/x")) == ("m", "checkpoint-1")
    assert tuple(one(ids, c="/r/checkpoint-9")) == ("base", "base")
    assert one(N.artifact_ids(F.col("c"), "default"), c=None)["checkpoint"] == "default"
    number = N.checkpoint_number(F.col("c"))
    assert [one(number, c=c) for c in ("base", "checkpoint-30", "checkpoint-x", "other")] == [0, 30, None, None]


def test_round_trip_over_segments(spark):
    rng = random.Random(3)
    turns = [
        (d, t, rng.choice(["User", "Assistant"]), "\n".join(rng.choice(["a", "b c", "é"]) for _ in range(rng.randint(1, 3))))
        for d in range(5)
        for t in range(rng.randint(1, 23))
    ]
    df = spark.createDataFrame(turns, "dialogue_id int, turn bigint, speaker string, text string").repartition(4)
    for size in (1, 4, None):
        docs = X.render_transcripts(df, segment_turns=size)
        back = X.explode_turns(X.with_turns(docs), "dialogue_id", segment_turns=size)
        assert sorted(tuple(r) for r in back.collect()) == sorted(turns)


def test_header(spark):
    settings = {field[0]: F.lit(field[0]) for _, *field in X.HEADER_LINES if field}
    df = spark.createDataFrame([(1, 0, "User", "a")], "dialogue_id int, turn bigint, speaker string, text string")

    def content(**changed):
        return X.render_transcripts(df, X.transcript_header(settings | changed)).first()["content"]

    full = content()
    assert full.startswith("AI1 (User) Parameters:\n- Model: ai1_model\n") and f"\n\n{MARK}\n\nUser: a\n\n" in full
    assert "  - Label: Error loading data\n" in content(persona_label=F.lit(None))
    assert content(user_prompt_title=F.lit(None)) == f"{MARK}\n\nUser: a\n\n"


def test_pairs_of_a_document_without_marker(spark):
    df = spark.createDataFrame([("no marker",)], "content string")
    assert X.with_pairs(df).first()["pairs"] == []
    assert X.with_turns(df).first()["turns"] is None
