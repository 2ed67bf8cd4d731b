"""Judge answers, the rating store, config table and prompts."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import analytics as A
from colloquy.operators import config_table as C
from colloquy.operators import prompts as P
from colloquy.operators import ratings as R
from colloquy.sources.writers import append_rating_load, current_ratings, replaced_ratings

CATEGORY = R.CATEGORY_LABELS


def answers(spark, text):
    return spark.createDataFrame([(1, text)], "id int, answer string")


def two(spark, text, **options):
    rows = R.parse_two_metric(answers(spark, text), "id", **options).collect()
    return sorted((r["pair_num"], r["metric_type"], r["quantitative"]) for r in rows)


def test_two_metric(spark):
    text = (
        "口調：9\n論理性：8\n【ペア1】\n①口調： 3 ：x\n論理性：2\n論理性：1\nコメント：a：b\n"
        "　【ペア2】\n口調：4\n【ペア３】 口調：7\n論理性:5\n口調：0\n論理性：４\n"
    )
    assert two(spark, text) == [(1, "logic", "1"), (1, "tone", "3"), (3, "logic", "４"), (3, "tone", "0")]
    assert two(spark, text, compact=True) == [
        (1, "logic", "8"), (1, "tone", "9"), (2, "logic", "1"), (2, "tone", "3"), (3, "logic", "４"), (3, "tone", "0"),
    ]
    assert two(spark, "no scores") == []


def test_four_metric_with_stale_category(spark):
    text = (
        f"{CATEGORY['logic']}\nスコア：9\n【ペア1】\nスコア：1\n{CATEGORY['tone']}です\nスコア： 3 ：x\nコメント：ok：more\n"
        f"{CATEGORY['format']}\nコメント：f\n 【ペア2】\nスコア：2\n■他\nスコア：4\n{CATEGORY['approach']}\nスコア：\n"
    )
    rows = R.parse_four_metric(answers(spark, text), "id").collect()
    got = {(r["pair_num"], r["metric_type"]): (r["quantitative"], r["qualitative"]) for r in rows}
    assert len(rows) == 8
    assert got[1, "logic"] == ("1", "") and got[1, "tone"] == ("3", "ok") and got[1, "format"] == ("", "f")
    assert got[2, "format"] == ("4", "") and got[2, "approach"] == ("", "") and got[2, "tone"] == ("", "")


def test_attach_cuts_to_the_shorter(one):
    pairs, ratings = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"))
    assert [tuple(x) for x in one(R.attach_ratings(pairs, ratings))] == [("a", "1")]
    assert one(R.attach_ratings(F.slice(pairs, 1, 0), ratings)) == []


STORE = "dialogue_id string, metric_type string, pair_num int, score double"


def test_upsert_is_idempotent_and_keeps_old_scores(spark, tmp_path):
    store = spark.createDataFrame([("a", "tone", 1, 3.0), ("a", "logic", 1, 2.0), ("b", "tone", 1, 1.0)], STORE)
    new = spark.createDataFrame([("a", "tone", 1, 4.0), ("a", "logic", 1, None), ("c", "tone", 2, 0.0)], STORE)
    expected = {("a", "tone", 1, 4.0), ("a", "logic", 1, 2.0), ("b", "tone", 1, 1.0), ("c", "tone", 2, 0.0)}
    once = R.upsert_ratings(store, new)
    assert {tuple(r) for r in once.collect()} == expected
    assert {tuple(r) for r in R.upsert_ratings(once, new).collect()} == expected
    path = str(tmp_path / "store")
    two = str(tmp_path / "two")
    for writer, df in (("s1", store), ("s2", new)):
        append_rating_load(df.filter("score is not null"), two, 0, writer)
    assert {tuple(r) for r in current_ratings(spark, two).collect()} == expected
    replaced = {tuple(r) for r in replaced_ratings(spark, two).collect()}
    assert replaced == {("a", "tone", 1, 4.0), ("b", "tone", 1, 1.0), ("c", "tone", 2, 0.0)}
    for load, df in ((0, store), (1, new), (1, new)):
        append_rating_load(df, path, load)
    assert {tuple(r) for r in current_ratings(spark, path).collect()} == expected
    config = spark.createDataFrame([("a",), ("b",)], "dialogue_id string")
    assert [r[0] for r in R.unknown_files(new, config).collect()] == ["c"]


def test_wide_keeps_pair_numbers(spark):
    long = spark.createDataFrame([("a", "tone", n, float(n)) for n in range(1, 6)], STORE)
    wide = R.ratings_wide(long, ["dialogue_id"], ("tone",))
    assert wide.columns == ["dialogue_id", *(f"tone_pair{n}" for n in range(1, 6))]
    parts = R.ratings_in_parts(long, ["dialogue_id"], ("tone",))
    for back in (A.melt_ratings(wide, ["dialogue_id"]), A.melt_ratings(parts, ["dialogue_id"], part_width=2)):
        assert {(r["pair_num"], r["score"], r["metric_pair"]) for r in back.collect()} == {(n, n, f"tone_pair{n}") for n in range(1, 6)}
    wide = parts.orderBy("part").collect()
    assert [(r["part"], r["tone_pair1"], r["tone_pair2"]) for r in wide] == [(0, 1, 2), (1, 3, 4), (2, 5, None)]


def test_fully_rated(spark):
    full = {m: ("1", "") for m in R.METRICS}
    def check(*pairs):
        schema = "pairs array<struct<evaluation struct<" + ",".join(
            f"{m}: struct<quantitative: string, qualitative: string>" for m in R.METRICS
        ) + ">>>"
        df = spark.createDataFrame([([(tuple(p[m] for m in R.METRICS) if p else None,) for p in pairs],)], schema)
        return df.select(R.is_fully_rated(F.col("pairs"))).first()[0]

    assert check(full, full) is True and check() is True
    assert check(full, full | {"tone": ("", "")}) is False
    assert check(full | {"logic": (None, "")}) is False and check(None) is False


def test_unrated(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_name string")
    store = spark.createDataFrame([("a", "3"), ("b", " 　"), ("b", None)], "file_name string, score string")
    assert sorted(r[0] for r in R.unrated_files(files, store).collect()) == ["b", "c"]


CONFIG = "pos int, q int, m string, dialogue string"


def test_config_table(spark):
    rows = [(0, 1, None, None), (1, 1, None, "x"), (2, 1, "a", " 　"), (3, 2, "a", "y"), (4, 2, "a", "")]
    config = spark.createDataFrame(rows, CONFIG).repartition(3)
    assert {r["pos"] for r in C.flag_duplicates(config, "q", "m").filter("is_duplicate").collect()} == {0, 1, 3, 4}
    assert {r["pos"] for r in C.drop_duplicates_keep_first(config, "q", "m", position="pos").collect()} == {0, 2, 3}
    assert {r["pos"] for r in C.pending_rows(config).collect()} == {0, 2, 4}
    produced = spark.createDataFrame([(1, None, "new"), (2, "a", "n2")], "q int, m string, dialogue string")
    out = {r["pos"]: r["dialogue"] for r in C.record_outputs(config, produced, ["q", "m"]).collect()}
    assert out == {0: "new", 1: "new", 2: " 　", 3: "n2", 4: "n2"}
    kept, unknown = C.check_catalog_ids(config, spark.createDataFrame([(1,)], "id int"), "q")
    assert (kept.count(), unknown.count()) == (3, 2)
    listing = spark.createDataFrame([("checkpoint-9",), ("checkpoint-100",), ("checkpoint-x",), ("other-999",)], "name string")
    assert C.latest_checkpoint(listing).first()["name"] == "checkpoint-100"


def test_fill_template(one):
    values = [("INITIAL_QUESTION", F.lit("q {{OTHERS}}")), ("PERSONA", F.lit(None).cast("string")), ("OTHERS", F.lit("o"))]
    fill = lambda t, **k: one(P.fill_template(F.col("t"), values, **k), t=t)
    assert fill("{{INITIAL_QUESTION}}!") == "q o!" and fill("plain") == "plain"
    assert fill("{{PERSONA}}") == "" and fill(None) == ""
    assert fill("plain", required=[F.lit(None)]) == ""


def test_catalog_first_entry_wins(spark):
    catalog = spark.createDataFrame([(1, "b", "second", 5), (1, "a", "first", 2), (2, "c", "only", 9)], "id int, label string, content string, position int")
    config = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None)], "r int, pid int")
    out = {r["r"]: (r["p_content"], r["p_found"]) for r in P.resolve_catalog(config, {"p": (catalog, "pid")}).collect()}
    assert out == {0: ("first", True), 1: ("only", True), 2: (None, False), 3: (None, False)}


def messages(*roles):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(str(i)).alias("content")) for i, r in enumerate(roles)])


def test_checked_context(one):
    kept = lambda *roles: [m["content"] for m in one(P.checked_context(messages(*roles)))]
    assert kept("user", "model", "user") == ["0", "1", "2"]
    assert kept("model", "user") == ["1"] and kept("user", "user", "model") == []


def test_history_of_zero_keeps_everything(one):
    out = one(P.full_history(messages("user", "model", "user")))
    assert [len(h) for h in out] == [1, 2, 3]
    with pytest.raises(ValueError):
        P.history_window(None, 0)


def test_flatten(one):
    history = messages("user", "model")
    common = dict(first_preamble=F.lit("F:"), preamble=F.lit("P:"))
    assert one(P.flatten_history(history, F.lit("n"), **common)) == 'P:User: "0"\nModel: 1\nUser: "n"'
    assert one(P.flatten_history(F.slice(history, 1, 0), F.lit("n"), **common)) == 'F:"n"'
    quoted = F.array(F.struct(F.lit("user").alias("role"), F.lit('say "a" and "b"').alias("content")))
    assert one(P.flatten_history(quoted, F.lit("n"), unquote=True, **common)) == 'P:User: "b"\nUser: "n"'


def test_completion(one):
    get = lambda t, **k: one(P.extract_completion(F.col("t"), **k), t=t)
    raw = "x<start_of_turn>model\nold<end_of_turn><start_of_turn>model\n a model b <end_of_turn>tail"
    assert get(raw) == "a model b" and get(raw, cut_role_word=True) == "b"
    assert get("nothing") == P.FAILED_COMPLETION and get("<start_of_turn>model open") == "open"


def test_flip_roles(one):
    flipped = one(P.flip_roles(messages("gemma", "claude"), {"gemma": "user"}, "assistant"))
    assert [m["role"] for m in flipped] == ["user", "assistant"]


def test_judge_request(one):
    pairs = F.array(F.struct(F.lit("User: a").alias("user"), F.lit("Assistant: b").alias("assistant")))
    text = one(P.build_judge_request(pairs, F.lit("{{PAIR_COUNT}}|{{ANSWER_FORM}}|{{PAIRS}}"), ["口調："]))
    assert text == "1|\n【ペア1】\n口調：\n|\n【ペア1】\nUser: a\nAssistant: b\n"
