"""Sessions closed by timers against a walk over the events; state that goes away; windows at the end of a log."""

import glob
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.streaming import jobs as J
from colloquy.streaming import sessions as T

SCHEMA = "run_id bigint, ts timestamp, step bigint, loss double"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def session(spark):
    return T.rocksdb_session(J.state_session(spark))


def events(rng, runs, n, days):
    """Events in hours; some have no loss."""
    out = []
    for step in range(n):
        at = START + timedelta(hours=rng.randrange(24 * days * 4) / 4)
        out.append((rng.randrange(runs), at, step, None if rng.random() < 0.2 else float(rng.randrange(100))))
    return out


def walked(rows, idle):
    found = []
    for run in sorted({r[0] for r in rows}):
        held = []
        for row in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            if held and row[1] - held[-1][1] > idle:
                found.append((run, held))
                held = []
            held.append(row)
        found.append((run, held))
    out = []
    for run, held in found:
        losses = [r[3] for r in held if r[3] is not None]
        out.append((run, held[0][1], held[-1][1], len(held), max(r[2] for r in held), min(losses, default=None), max(losses, default=None), losses[-1] if losses else None))
    return sorted(out, key=str)


def run(session, folder, name, rows, idle, marker=None):
    """Write the events as one file, and let the stream see what is new."""
    source, markers = f"{folder}/{name}-log", f"{folder}/{name}-markers"
    log = session.createDataFrame(rows, SCHEMA)
    log.coalesce(1).write.mode("append").parquet(source)
    T.write_end_marker(log, markers, marker)
    stream = T.with_end_marker(session.readStream.schema(SCHEMA).parquet(source), markers)
    query = T.stream_idle_runs(stream, f"{folder}/{name}-out", f"{folder}/{name}-checkpoint", idle)
    query.awaitTermination()
    closed = session.read.schema(T_OUT).parquet(f"{folder}/{name}-out").collect() if glob.glob(f"{folder}/{name}-out/*.parquet") else []
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(map(tuple, closed), key=str), states


T_OUT = "run_id bigint, started timestamp, ended timestamp, n_events bigint, last_step bigint, min_loss double, max_loss double, final_loss double"


def test_sessions_and_their_state(session, tmp_path):
    rng = random.Random(3)
    rows = events(rng, 7, 300, 20)
    early, late = [r for r in rows if r[1] < START + timedelta(days=10)], [r for r in rows if r[1] >= START + timedelta(days=10)]
    idle = timedelta(hours=6)
    closed, held = run(session, tmp_path, "two", early, "6 hours")
    assert closed and set(closed) <= set(walked(rows, idle))
    run(session, tmp_path, "two", late, "6 hours")
    closed, states = run(session, tmp_path, "two", [], "6 hours", START + timedelta(days=90))
    assert closed == walked(rows, idle)
    # What the closed sessions held is gone; what is left is that of the marker itself.
    assert max(held) >= 7 and states[-1] <= 4


def test_events_out_of_order_merge_sessions(session, tmp_path):
    at = [START + timedelta(minutes=m) for m in (0, 90, 45, 300)]
    rows = [(1, t, i, float(i)) for i, t in enumerate(at)]
    run(session, tmp_path, "order", rows[:2], "1 hour")
    run(session, tmp_path, "order", rows[2:], "1 hour")
    closed, _ = run(session, tmp_path, "order", [], "1 hour", START + timedelta(days=9))
    assert closed == [(1, at[0], at[1], 3, 2, 0.0, 2.0, 1.0), (1, at[3], at[3], 1, 3, 3.0, 3.0, 3.0)]


def test_merged_parts_equal_events():
    """Any way to fold events into parts gives the same sessions."""
    rng = random.Random(8)
    rows = events(rng, 3, 120, 9)
    micros = pd.Timestamp(START).value // 1000
    frame = pd.DataFrame(rows, columns=["run_id", "ts", "step", "loss"])
    frame["at"] = frame["ts"].astype("datetime64[us]").astype("int64")
    idle = 3 * 3600 * 1_000_000
    fold = T._fold("run_id", idle)
    whole = next(fold(iter([frame])))
    parts = pd.concat(list(fold(iter([frame[i::5] for i in range(5)]))), ignore_index=True)
    again = T.merge_parts(parts, ["run_id"], idle)
    assert micros and again.astype(object).where(again.notna(), None).values.tolist() == whole.astype(object).where(whole.notna(), None).values.tolist()
    assert len(whole) == len(walked(rows, timedelta(hours=3)))


def test_windows_close_at_the_end_of_a_log(session, tmp_path):
    log = session.createDataFrame([(1, START + timedelta(days=d, hours=12), d, 1.0) for d in range(3)], SCHEMA)
    log.write.parquet(f"{tmp_path}/log")
    counts = []
    for marker in (None, START + timedelta(days=30)):
        T.write_end_marker(log, f"{tmp_path}/markers", marker)
        stream = T.with_end_marker(session.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log"), f"{tmp_path}/markers")
        J.stream_windows(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        counts.append(session.read.parquet(f"{tmp_path}/out").filter(F.col("run_id").isNotNull()).count())
    assert counts == [2, 3] and session.read.parquet(f"{tmp_path}/out").count() == 3


def test_rows_merge_as_frames():
    """The state of a run is merged row by row, with the result of the frames."""
    rng = random.Random(4)
    for _ in range(40):
        parts = []
        for step in range(rng.randrange(1, 12)):
            started, lossy = rng.randrange(60), rng.random() < 0.7
            loss = float(rng.randrange(9))
            parts.append((started, started + rng.randrange(9), rng.randrange(1, 4), rng.choice([step, None]), *([loss, loss, loss, started, step] if lossy else [None] * 5)))
        frame = pd.DataFrame(parts, columns=T._NAMES).astype(T._NULLABLE)
        want = T.merge_parts(frame, [], 5).astype(object)
        got = T.merge_rows([T._PART(*part) for part in parts], 5)
        assert [tuple(row) for row in got] == [tuple(row) for row in want.where(want.notna(), None).values.tolist()]


def test_null_run_beside_others(session, tmp_path):
    """Rows without a run are a run of their own and take no other run's rows."""
    rows = [(key, START + timedelta(minutes=m), m, 1.0) for key in [None, *range(1, 31)] for m in (0, 5, 9)]
    run(session, tmp_path, "null", rows, "1 hour")
    closed, _ = run(session, tmp_path, "null", [], "1 hour", START + timedelta(days=9))
    assert closed == sorted([(key, START, START + timedelta(minutes=9), 3, 9, 1.0, 1.0, 1.0) for key in [None, *range(1, 31)]], key=str)
