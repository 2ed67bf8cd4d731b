"""Runs that end by falling silent: a stateful processor with event-time timers.

A session of a run is a chain of its log events in which no step is longer than ``idle``. An open session lives in the state of its
run. A timer fires when the watermark has passed the session's last event by ``idle``: its row is emitted, and its state
goes. So the state holds the runs that are active, not all that there ever were. Events may come in any order within the
watermark's delay: sessions that an event bridges are merged.

A task first folds its own rows into parts of sessions, so a run with a large share of all events crosses the shuffle as a few rows
for each batch, and its state is updated by those.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: A part of a session; times are microseconds. ``final_at`` and ``final_step`` place the last event that has a loss.
PART = (
    "started bigint, ended bigint, n_events bigint, last_step bigint, min_loss double, max_loss double, "
    "final_loss double, final_at bigint, final_step bigint"
)
_NAMES = [field.split()[0] for field in PART.split(", ")]
_PART = Row(*_NAMES)
_FINAL = ["final_loss", "final_at", "final_step"]
_NULLABLE = {"final_at": "Int64", "final_step": "Int64", "last_step": "Int64"}


def rocksdb_session(session: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    session.conf.set(STATE_PROVIDER, ROCKSDB)
    return session


def merge_parts(parts: pd.DataFrame, keys: list[str], idle: int) -> pd.DataFrame:
    """Parts of sessions (``keys`` and the columns of ``PART``) merged wherever a step between them is at most ``idle`` microseconds."""
    if parts.empty:
        return parts
    parts = parts.sort_values([*keys, "started", "ended"], kind="stable", ignore_index=True)
    owner = parts.groupby(keys, dropna=False, sort=False).ngroup() if keys else pd.Series(0, index=parts.index)
    # A long part may reach beyond later, shorter ones: the latest end so far counts.
    reach = parts["ended"].groupby(owner).cummax().shift()
    session = (owner.ne(owner.shift()) | (parts["started"] - reach > idle)).cumsum()
    merged = parts.groupby(session).agg(
        {"started": "min", "ended": "max", "n_events": "sum", "last_step": "max", "min_loss": "min", "max_loss": "max"}
    )
    for key in keys:
        merged[key] = parts[key].groupby(session).nth(0).to_numpy()
    carrying = parts.assign(_session=session)[parts["final_at"].notna()]
    carrying = carrying.sort_values(["_session", "final_at", "final_step"], kind="stable")
    merged[_FINAL] = carrying.drop_duplicates("_session", keep="last").set_index("_session")[_FINAL].reindex(merged.index)
    return merged[[*keys, *_NAMES]].astype(_NULLABLE).reset_index(drop=True)


def _fold(key: str, idle: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            lossy = rows["loss"].notna()
            parts = pd.DataFrame(
                {
                    key: rows[key], "started": rows["at"], "ended": rows["at"], "n_events": 1, "last_step": rows["step"].astype("Int64"),
                    "min_loss": rows["loss"], "max_loss": rows["loss"], "final_loss": rows["loss"],
                    "final_at": rows["at"].astype("Int64").where(lossy), "final_step": rows["step"].astype("Int64").where(lossy),
                }
            )
            yield merge_parts(parts, [key], idle)

    return fold


def _later(one: Row, other: Row) -> bool:
    """Whether the last loss of ``one`` is at or behind that of ``other``; a null step is behind all others."""
    if one.final_at is None or other.final_at is None:
        return one.final_at is not None
    places = [(part.final_at, part.final_step is None, part.final_step or 0) for part in (one, other)]
    return places[0] >= places[1]


def _least_and_most(*values) -> tuple:
    known = [v for v in values if v is not None]
    return (min(known), max(known)) if known else (None, None)


def merge_rows(parts: list[Row], idle: int) -> list[Row]:
    """``merge_parts`` for the parts of one run, as rows with the columns of ``PART``: a frame for each run costs far more than its rows."""
    merged: list[Row] = []
    for part in sorted(parts, key=lambda p: (p.started, p.ended)):
        if not merged or part.started - merged[-1].ended > idle:
            merged.append(part)
            continue
        held = merged[-1]
        final = part if _later(part, held) else held
        merged[-1] = _PART(
            held.started, max(held.ended, part.ended), held.n_events + part.n_events, _least_and_most(held.last_step, part.last_step)[1],
            _least_and_most(held.min_loss, part.min_loss)[0], _least_and_most(held.max_loss, part.max_loss)[1],
            final.final_loss, final.final_at, final.final_step,
        )
    return merged


class IdleRuns(StatefulProcessor):
    """Open sessions of a run in a list state, and a timer for the one that closes first."""

    def __init__(self, key: str, idle: int):
        self.key = key
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", PART)

    def _held(self) -> list[Row]:
        return [_PART(*row) for row in self.open.get()]

    def _timer(self, sessions: list[Row]) -> int | None:
        """The first whole millisecond beyond the end of the session that closes first."""
        return (min(s.ended for s in sessions) + self.idle) // 1000 + 1 if sessions else None

    def _keep(self, sessions: list[Row], before: list[Row]) -> None:
        old, new = self._timer(before), self._timer(sessions)
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is None:
            self.open.clear()
            return
        self.open.put([tuple(s) for s in sessions])
        if old != new:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        parts = [_PART(*(row[name] for name in _NAMES)) for row in rows]
        if parts:
            self._keep(merge_rows(held + parts, self.idle), held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        # All that the watermark has passed, as a timer set now would wait for the next batch.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        done = [s for s in held if (s.ended + self.idle) // 1000 < passed]
        self._keep([s for s in held if (s.ended + self.idle) // 1000 >= passed], held)
        for session in done:
            yield Row(self.key, *_NAMES[:-2])(key[0], *session[:-2])

    def close(self) -> None:
        pass


def idle_runs(log: DataFrame, idle: str = "1 hour", delay: str = "1 hour", key: str = "run_id") -> DataFrame:
    """Closed sessions ``(key, started, ended, n_events, last_step, min_loss, max_loss, final_loss)`` of a stream of log rows.

    ``log`` has ``key``, ``ts``, ``step`` and ``loss``; rows without a time are left out. The session needs ``rocksdb_session``.
    """
    gap = pd.Timedelta(idle) // pd.Timedelta(microseconds=1)
    kind = log.schema[key].dataType.simpleString()
    rows = log.filter("ts is not null").select(key, F.unix_micros("ts").alias("at"), "step", "loss")
    parts = rows.mapInPandas(_fold(key, gap), f"`{key}` {kind}, {PART}").withColumn("seen", F.timestamp_micros("ended"))
    closed = (
        parts.withWatermark("seen", delay)
        .groupBy(key)
        .transformWithState(
            IdleRuns(key, gap), f"`{key}` {kind}, {PART.rsplit(', ', 2)[0]}", outputMode="Append", timeMode="EventTime"
        )
    )
    return closed.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def stream_idle_runs(
    log: DataFrame, out: str, checkpoint: str, idle: str = "1 hour", delay: str = "1 hour", key: str = "run_id"
) -> StreamingQuery:
    """Closed sessions appended to a Parquet table."""
    return (
        idle_runs(log, idle, delay, key)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def with_end_marker(log: DataFrame, markers: str) -> DataFrame:
    """The stream together with a folder of end markers: rows with a time and nothing else.

    When a log is complete, one marker far behind its last event moves the watermark past everything that is still open. A
    marker has a null key; its own window or session never closes, so it leaves no row.
    """
    return log.unionByName(log.sparkSession.readStream.schema(log.schema).parquet(markers))


def write_end_marker(log: DataFrame, markers: str, at: datetime | None) -> None:
    """A marker at the time ``at`` in the columns of ``log``; None only makes the folder, which a stream needs to start."""
    row = log.sparkSession.range(1 if at else 0)
    values = [F.lit(at if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in log.schema.fields]
    row.select(*values).write.mode("append").parquet(markers)
