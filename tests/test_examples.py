"""Training examples: windows, checks, masks and splits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import TOKEN, token_count
from colloquy.operators import examples as E

MESSAGES = "id int, messages array<struct<role string, content string>>"


def chat(spark, *examples):
    return spark.createDataFrame(list(enumerate(examples)), MESSAGES)


def test_windows_agree_between_long_and_nested(spark):
    turns = [(d, t, "User" if t % 2 == 0 else "Assistant", f"{d}-{t}") for d, n in ((0, 3), (1, 4), (2, 27)) for t in range(n)]
    long = spark.createDataFrame(turns, "d int, turn bigint, speaker string, text string")
    nested = long.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("x")).select(
        "d", F.transform("x", lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))).alias("turns")
    )
    windows = [*E.WINDOWS, (0, 0), (1, 3)]

    def found(df):
        return sorted((r["d"], r["start"], r["end"], tuple(m["text"] for m in r["messages"])) for r in df.collect())

    expected = sorted(
        (d, s, e, tuple(f"{d}-{t}" for t in range(s - 1, e)))
        for d, n in ((0, 3), (1, 4), (2, 27)) for s, e in windows if s and e <= n
    )
    assert found(E.windows_from_turns(long.repartition(3), "d", windows=windows)) == expected
    assert found(E.extract_windows(nested, "d", windows=windows)) == expected
    assert E.windows_from_turns(long, "d", windows=[(0, 0)]).count() == 0


def test_to_chat_escapes_and_prefixes_first_message(spark):
    df = spark.createDataFrame(
        [("f", 3, 4, [("Assistant", "a\nb"), ("User", "c\\n")])],
        "f string, start int, end int, messages array<struct<speaker string, text string>>",
    )
    row = E.to_chat(df, "f", "P").first()
    assert row["extract_range"] == "3-4"
    assert [tuple(m) for m in row["messages"]] == [("model", "Pa\\nb"), ("user", "c\\n")]


def test_classification(spark):
    u, m = ("user", "q"), ("model", "a")
    df = chat(spark, [u, m], [("system", "x"), m], [("user", None), m], [m, u], [u, m, u], [u, m, m, u], [u], [], [u, u])
    out = {r["id"]: r["reject_reason"] for r in E.classify_examples(df).collect()}
    assert out == {0: None, 1: "format", 2: "format", 3: "order", 4: None, 5: "order", 6: "empty", 7: "empty", 8: "order"}
    report = {r["reject_reason"]: r["n"] for r in E.reject_report(E.classify_examples(df)).collect()}
    assert report == {"kept": 2, "format": 2, "order": 3, "empty": 2}


def test_rendered_text_and_limit(spark):
    row = E.classify_examples(chat(spark, [("user", " q "), ("model", "a"), ("user", "cut")])).first()
    assert row["text"] == (
        "<bos><start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\na<end_of_turn>\n<start_of_turn>model\n"
    )
    n = row["n_tokens"]
    df = chat(spark, [("user", "q"), ("model", "a")])
    assert E.classify_examples(df, n).first()["reject_reason"] is None
    assert E.classify_examples(df, n - 1).first()["reject_reason"] == "length"


def test_pluggable_tokenizer(spark):
    def characters():
        return lambda text: [ord(c) for c in text]

    df = spark.createDataFrame([("abc",), ("abcdef",), ("",)], "text string")
    kept = E.within_token_budget(df, max_tokens=3, tokenizer=characters)
    assert sorted((r["text"], r["n_tokens"]) for r in kept.collect()) == [("", 0), ("abc", 3)]
    padded = {r["text"]: (r["input_ids"], r["attention_mask"]) for r in E.tokenize_pad_with(df, characters, max_len=4).collect()}
    assert padded["abc"] == ([97, 98, 99, 0], [1, 1, 1, 0])
    assert padded["abcdef"] == ([97, 98, 99, 100], [1] * 4)
    examples = chat(spark, [("user", "q"), ("model", "a")])
    assert E.classify_examples(examples, 10, characters).first()["reject_reason"] == "length"


def test_builtin_padding(spark):
    df = spark.createDataFrame([("one two!",), ("",)], "text string")
    rows = {r["text"]: r for r in E.tokenize_pad(df, max_len=6).collect()}
    assert rows["one two!"]["attention_mask"] == [1, 1, 1, 1, 0, 0] and rows["one two!"]["input_ids"][0] == E.BOS_ID
    assert rows[""]["input_ids"] == [E.BOS_ID, 0, 0, 0, 0, 0]


def test_pattern_hits(spark):
    df = spark.createDataFrame([("君は行くのかね。では。 。",), ("何だろうか",), ("",)], "text string")
    hits = {r["pattern"]: (r["n_sentences"], r["n_rows"]) for r in E.pattern_hits(df).collect()}
    assert hits["かね"] == hits["のかね"] == hits["君は"] == hits["では"] == hits["だろうか"] == (1, 1)
    assert hits["君が"] == (0, 0)


def brute_mask(text, mask, patterns, end, anchor, pad=2):
    def size(s):
        return len(re.findall(TOKEN, s))

    out, at, n = list(mask), 0, len(mask)
    for sentence in text.split(end):
        if not sentence.strip():
            continue
        for p in patterns:
            if p in sentence:
                before = size(sentence) - size(p) if anchor == "tail" else size(sentence[: sentence.index(p)])
                for i in range(max(0, at + before - pad), min(n, at + before + size(p) + pad)):
                    out[i] = 1
        at += size(sentence + end)
    out[0] = out[-1] = 1
    return out


@pytest.mark.parametrize("anchor", ["tail", "actual"])
def test_mask_stands_on_the_ids(spark, anchor):
    rng = random.Random(4)
    words = ["かね", "では", "君は", "猫", "word ", " ", "。", "\u3000", "ではないかね"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["dog かね。", "。かね"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = {r["i"]: r for r in E.tokenize_pad(df, max_len=24).collect()}
    for r in E.tokenize_mask(df, max_len=24, anchor=anchor).collect():
        own = re.findall(TOKEN, r["text"])
        ends = [m.end() for m in re.finditer(TOKEN, r["text"])][:23]
        whole = E.BOS_MARK + r["text"][: ends[-1] if ends else 0] + E.PAD_MARK * max(0, 23 - len(own))
        assert r["input_ids"] == plain[r["i"]]["input_ids"]
        assert r["attention_mask"] == brute_mask(whole, plain[r["i"]]["attention_mask"], E.PATTERNS, "。", anchor)


@pytest.mark.parametrize("anchor", ["tail", "actual"])
def test_span_mask_matches_brute_force(spark, anchor):
    rng = random.Random(2)
    words = ["かね", "だろうか", "では", "君は", "猫", "word", " ", "。", "。。", "ではないかね", "について"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, [0] * 24) for i, t in enumerate(texts)], "i int, text string, attention_mask array<int>")
    out = {r["i"]: r["attention_mask"] for r in E.pattern_span_mask(df, anchor=anchor).collect()}
    for i, text in enumerate(texts):
        assert out[i] == brute_mask(text, [0] * 24, E.PATTERNS, "。", anchor), text
    with pytest.raises(ValueError):
        E.pattern_span_mask(df, anchor="middle")


def test_shuffle_is_stable_under_repartitioning(spark):
    df = spark.range(500)
    a = [r["id"] for r in E.seeded_shuffle(df.repartition(7), 42, "id").collect()]
    b = [r["id"] for r in E.seeded_shuffle(df.repartition(2), 42, "id").collect()]
    assert a == b and a != sorted(a) and a != [r["id"] for r in E.seeded_shuffle(df, 43, "id").collect()]


@pytest.mark.parametrize("n, cap", [(0, 50), (1, 50), (10, 1), (333, 50), (333, None), (5000, 50)])
def test_exact_split(spark, n, cap):
    out = E.train_eval_split(spark.range(n), E.shuffle_key(1, "id"), "id", eval_cap=cap).collect()
    sides = {s: {r["id"] for r in out if r["split"] == s} for s in ("train", "eval", "unused")}
    n_train = int(n * 0.8)
    n_eval = min(n - n_train, cap) if cap is not None else n - n_train
    assert [len(sides[s]) for s in ("train", "eval", "unused")] == [n_train, n_eval, n - n_train - n_eval]
    assert len(out) == n and set().union(*sides.values()) == set(range(n))


def test_exact_split_follows_the_rank(spark):
    # all rows in a handful of buckets, so borders fall inside them
    df = spark.range(200).withColumn("h", F.col("id") % 50)
    out = E.train_eval_split(df, F.col("h"), "id", eval_cap=30).collect()
    order = sorted((r["h"], r["id"], r["split"]) for r in out)
    assert [s for *_, s in order] == ["train"] * 160 + ["eval"] * 30 + ["unused"] * 10


def test_exact_split_of_close_ranks(spark):
    df = spark.range(30_000).withColumn("h", F.col("id") * 1000 - 5_000_000)
    out = E.train_eval_split(df, F.col("h"), "id").collect()
    assert [r["split"] for r in sorted(out, key=lambda r: r["h"])] == ["train"] * 24_000 + ["eval"] * 50 + ["unused"] * 5_950


def test_exact_split_of_equal_ranks(spark):
    """More rows of one rank than a histogram has bins: the keys decide."""
    out = E.train_eval_split(spark.range(9000).repartition(5), F.lit(-7).cast("bigint"), "id").collect()
    assert [r["split"] for r in sorted(out)] == ["train"] * 7200 + ["eval"] * 50 + ["unused"] * 1750


@pytest.mark.parametrize("n_groups, cap", [(0, 50), (1, 50), (40, 7), (40, None), (9000, 50)])
def test_group_split(spark, n_groups, cap):
    """Groups of 0 to 6 rows and one of a third of all; against a walk through the groups in order."""
    groups = spark.range(n_groups).withColumn("n", F.when(F.col("id") == 3, n_groups).otherwise(F.col("id") % 7))
    df = groups.select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), "n")).alias("i")).filter("i > 0")
    out = E.group_split(df.repartition(4), E.shuffle_key(5, "id"), "id", eval_cap=cap)
    sizes = {r["id"]: r["count"] for r in df.groupBy("id").count().collect()}
    order = [r["id"] for r in groups.select("id", E.shuffle_key(5, "id").alias("h")).orderBy("h", "id").collect() if r["id"] in sizes]
    total, through, expected = sum(sizes.values()), 0, {}
    limit = int(total * 0.8)
    for g in order:
        through += sizes[g]
        expected[g] = "train" if through <= limit else "eval" if cap is None or through <= limit + cap else "unused"
    got = {(r["id"], r["split"]) for r in out.collect()}
    assert got == set(expected.items()) and out.count() == total


def test_bucket_split_keeps_groups_together(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 300)
    out = E.bucket_split(df.repartition(6), 7, "g")
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = out.filter("split = 'train'").count() / 3000
    assert 0.7 < share < 0.9


def test_profile(spark):
    df = spark.createDataFrame([("a b",), (None,), ("c",)], "t string")
    row = E.profile_examples(df, F.when(F.col("t").isNotNull(), token_count(F.col("t")))).first()
    assert tuple(row) == (3, 2, 1, 2, 3)
