"""Sources, sinks and streaming jobs on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from colloquy.operators import runlog as L
from colloquy.operators.config_table import latest_file
from colloquy.operators import transcripts as X
from colloquy.plans.jobs import prepare_examples
from colloquy.session import shared_path
from colloquy.sources import readers as S
from colloquy.sources import writers as W
from colloquy.streaming import jobs as J


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_transcripts_fold_newlines_and_skip_other_files(spark, tmp_path):
    write(tmp_path / "t" / "dialogue_a_1.txt", "h\r\n=== Dialogue Log ===\r\nUser: a\r\rb c\r\nAssistant: d")
    write(tmp_path / "t" / "note.md", "User: x")
    row = X.with_turns(S.read_transcripts(spark, str(tmp_path / "t"))).collect()
    assert len(row) == 1 and row[0]["file_name"] == "dialogue_a_1.txt"
    assert [tuple(t) for t in row[0]["turns"]] == [("User", "a\nb c"), ("Assistant", "d")]


def test_run_config(spark, tmp_path):
    write(
        tmp_path / "c.csv",
        'AI1_TEMPERATURE,MAX_TURNS,DIALOGUE_KEYWORD,dialogue,tone_pair1\n0.3,2,"k, ""q""",,3\n,,,,\nhot,x,k2, ,\n0.7,4,k3,d.txt,\n',
        "utf-8-sig",
    )
    rows = sorted(S.read_run_config(spark, str(tmp_path / "c.csv")).collect(), key=lambda r: r["position"])
    assert [r["DIALOGUE_KEYWORD"] for r in rows] == ['k, "q"', "k2", "k3"]
    assert [r["AI1_TEMPERATURE"] for r in rows] == [0.3, None, 0.7] and [r["MAX_TURNS"] for r in rows] == [2, None, 4]
    assert [r["dialogue"] for r in rows] == [None, " ", "d.txt"] and rows[0]["tone_pair1"] == "3"


def test_wide_ratings_read_missing_tokens(spark, tmp_path):
    write(tmp_path / "w.csv", "model_version,checkpoint,tone_pair1\nNA,,3\nm,c, 4 \nn,nan,null\n")
    rows = S.read_ratings_wide(spark, str(tmp_path / "w.csv")).collect()
    assert [tuple(r) for r in rows] == [(None, None, "3"), ("m", "c", " 4 "), ("n", None, None)]


def test_catalog(spark, tmp_path):
    write(tmp_path / "c.json", json.dumps({"others": [{"id": 2, "label": "b", "content": "x"}, {"id": 1, "title": "t", "content": "y"}]}, indent=2))
    rows = S.read_catalog(spark, str(tmp_path / "c.json"), "others").orderBy("position").collect()
    assert [(r["kind"], r["id"], r["label"], r["title"], r["content"]) for r in rows] == [
        ("others", 2, "b", None, "x"), ("others", 1, None, "t", "y"),
    ]


def test_scored_dialogues(spark, tmp_path):
    verdict = {"quantitative": "3", "qualitative": "c"}
    doc = {
        "metadata": {"question_id": 7, "timestamp": "t", "model_version": "m", "checkpoint": "c", "topic": "q"},
        "pairs": [{"pair_id": 1, "claude": {"content": "u"}, "gemma": {"content": "a"}, "evaluation": {"tone": verdict}}],
    }
    write(tmp_path / "d" / "one.json", json.dumps(doc, indent=2))
    row = S.read_scored_dialogues(spark, str(tmp_path / "d")).first()
    assert (row["file_name"], row["metadata"]["question_id"], row["pairs"][0]["gemma"]["content"]) == ("one.json", 7, "a")
    assert row["pairs"][0]["evaluation"]["tone"]["quantitative"] == "3" and row["pairs"][0]["evaluation"]["logic"] is None


def test_chat_corpus_array_and_lines(spark, tmp_path):
    examples = [{"source_file": f"f{i}", "extract_range": "3-4", "messages": [{"role": "user", "content": "あ\n"}]} for i in range(3)]
    write(tmp_path / "a.json", json.dumps(examples, indent=2, ensure_ascii=False))
    corpus = S.read_chat_corpus(spark, str(tmp_path / "a.json"))
    for _ in range(2):
        W.write_chat_corpus(corpus, str(tmp_path / "out"))
    again = S.read_chat_corpus(spark, str(tmp_path / "out"), json_lines=True)
    assert sorted(again.collect()) == sorted(corpus.collect()) and again.count() == 3


def test_listing_and_latest(spark, tmp_path):
    names = ["dialogue_a_b_20240101_000000_2.txt", "dialogue_a_b_20240102_000000_2.txt", "dialogue_a_b_20240101_000000_3.txt"]
    for i, name in enumerate([*names, "dialogue_a_x.txt", "other.txt"]):
        write(tmp_path / "l" / name, "x")
        os.utime(tmp_path / "l" / name, (1000 - 10 * i, 1000 - 10 * i))
    files = S.list_files(spark, str(tmp_path / "l"), "dialogue_*.txt")
    assert files.count() == 4 and set(files.columns) == {"file_name", "path", "modified"}
    latest = {(r["keyword"], r["turns"]): r["file_name"] for r in latest_file(files).collect()}
    assert latest == {("a_b", 2): names[0], ("a_b", 3): names[2]}


def test_routing_leaves_the_source(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "dialogue string, content string")
    verdicts = spark.createDataFrame([("a", "low"), ("b", "ok")], "dialogue string, verdict string")
    W.route_low_rated(docs, verdicts, str(tmp_path / "r"))
    routed = spark.read.parquet(str(tmp_path / "r"))
    assert {(r["dialogue"], r["rating_bucket"]) for r in routed.collect()} == {("a", "low"), ("b", "ok"), ("c", "unrated")}


def test_preparation_flow(spark, tmp_path):
    turns = "\n\n".join(f"{'User' if i % 2 == 0 else 'Assistant'}: t{i}" for i in range(7))
    write(tmp_path / "p" / "d.txt", f"=== Dialogue Log ===\n\n{turns}\n")
    out = prepare_examples(S.read_transcripts(spark, str(tmp_path / "p")), prefix="P ").collect()
    assert sorted((r["extract_range"], r["reject_reason"]) for r in out) == [("3-4", None), ("5-6", None)]
    assert "P t2" in out[0]["text"] + out[1]["text"]


def test_stream_of_files_equals_batch_and_sees_only_new_ones(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("s", "out", "cp"))

    def run():
        J.stream_turns(S.stream_transcripts(spark, source, 1), out, checkpoint, "file_name").awaitTermination()
        return spark.read.parquet(out)

    write(tmp_path / "s" / "a.txt", "=== Dialogue Log ===\nUser: a\nAssistant: b\n")
    write(tmp_path / "s" / "none.txt", "no marker")
    assert run().count() == 2
    write(tmp_path / "s" / "c.txt", "=== Dialogue Log ===\nUser: c\n")
    streamed = run()
    batch = X.explode_turns(X.with_turns(S.read_transcripts(spark, source)), "file_name")
    assert sorted(streamed.collect()) == sorted(batch.select(*streamed.columns).collect())
    assert run().count() == 3


LOG = "run_id bigint, ts timestamp, step bigint, loss double, learning_rate double, epoch double"


def log_rows(spark, *rows):
    return spark.createDataFrame(rows, "run_id bigint, ts string, step bigint, loss double, learning_rate double, epoch double").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def test_run_summary_and_moving_average(spark):
    log = log_rows(
        spark, (1, "2024-01-01 00:00:00", 1, 3.0, None, 0.1), (1, "2024-01-01 00:00:10", 2, None, 0.5, 0.2),
        (1, "2024-01-01 00:01:00", 3, 1.0, 0.4, 0.3), (1, "2024-01-01 00:02:00", 4, 2.0, None, 0.4),
        (2, "2024-01-02 00:00:00", 7, None, None, 1.0),
    )
    rows = {r["run_id"]: r for r in L.run_summary(log, "run_id").collect()}
    one = rows[1]
    assert (one["final_loss"], one["best_loss"], one["total_steps"], one["duration_seconds"]) == (2.0, 1.0, 4, 120)
    assert (one["initial_learning_rate"], one["final_learning_rate"], one["final_epoch"]) == (0.5, 0.4, 0.4)
    assert rows[2]["final_loss"] is None and rows[2]["duration_seconds"] == 0
    means = {r["step"]: r["moving_avg_loss"] for r in L.moving_average_loss(log, 2, "run_id", "step").collect()}
    assert means == {1: 3.0, 3: 2.0, 4: 1.5}


def test_log_events_and_devices(spark, tmp_path):
    raw = spark.createDataFrame([('{"step": 50, "loss": 1.5}',), ("{}",)], "line string")
    assert [(r["step"], r["loss"], r["epoch"]) for r in L.run_log_rows(raw).collect()] == [(50, 1.5, None), (None, None, None)]
    device = "array<struct<timestamp: string, metrics: array<struct<device: int, vram_used: double, utilization: double>>>>"
    nested = spark.createDataFrame([(1, [("t", [(0, 1.0, 50.0), (1, 2.0, 40.0)])])], f"run int, gpu_metrics {device}")
    peaks = L.device_peaks(L.device_metrics(nested, "run"), "run").first()
    assert (peaks["peak_vram"], peaks["peak_utilization"]) == (2.0, 50.0)
    reading = {"device": 1, "vram_used": 0.5, "utilization": 3.0}
    write(tmp_path / "h.json", json.dumps({"gpu_metrics": [{"timestamp": "t", "metrics": [reading]}], "other": 1}, indent=2))
    assert L.device_metrics(S.read_device_log(spark, str(tmp_path / "h.json"))).first()["vram_used"] == 0.5


def test_run_log_stream_is_restartable(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("s", "out", "cp"))
    first = log_rows(spark, *[(1, "2024-01-01 00:00:00", i, float(i), None, None) for i in range(60)])
    second = log_rows(spark, *[(1, "2024-01-01 00:00:00", i, -1.0, None, None) for i in range(60, 120)])
    for part in (first, second):
        part.write.mode("append").parquet(source)
        J.stream_run_log(spark.readStream.schema(LOG).parquet(source), out, checkpoint).awaitTermination()
    streamed = J.current_rollup(spark, out)
    batch = L.interval_rollup(spark.read.schema(LOG).parquet(source))
    assert sorted(streamed.select(*batch.columns).collect()) == sorted(batch.collect())


def test_windows_close_with_the_watermark(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("s", "out", "cp"))
    rows = [(1, f"2024-01-0{d} 12:00:00", d, 1.0, None, None) for d in (1, 2, 3)]
    log_rows(spark, *rows).write.parquet(source)
    J.stream_windows(spark.readStream.schema(LOG).parquet(source), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2


class FakeSession:
    """What shared_path asks a session for; the real setting is fixed when a session starts."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})


def test_shared_path_follows_the_session():
    assert shared_path(FakeSession("yarn", "/shared/cp/"), "x").startswith("/shared/cp/x-")
    with pytest.raises(ValueError):
        shared_path(FakeSession("local[4]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(FakeSession("yarn"), "x")


def test_run_config_position_follows_files(spark, tmp_path):
    header = "DIALOGUE_KEYWORD,dialogue\n"
    write(tmp_path / "c" / "a.csv", header + "first,\n")
    write(tmp_path / "c" / "b.csv", header + "".join(f"k{i},d{i}.txt\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = S.read_run_config(spark, str(tmp_path / "c"))
        assert rows.rdd.getNumPartitions() > 2
        ordered = [r["DIALOGUE_KEYWORD"] for r in rows.orderBy("position").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == ["first", *(f"k{i}" for i in range(20_000))]
