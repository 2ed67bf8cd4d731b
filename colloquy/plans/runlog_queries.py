"""Run-log analytics over ``events`` read as training logs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from colloquy.operators import runlog as L
from colloquy.plans.inputs import RUN_LOG, run_log, table
from colloquy.plans.registry import query
from colloquy.session import shared_path
from colloquy.streaming import jobs as J
from colloquy.streaming import sessions as T


def _log(spark, sf_dir):
    return run_log(table(spark, sf_dir, "events"))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = J.state_session(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return run_log(events)


@query(
    f"""WITH {RUN_LOG} SELECT run_id, step, round(loss, 6) AS loss, round(learning_rate, 6) AS learning_rate,
  round(epoch, 6) AS epoch FROM run_log"""
)
def run_log_rows(spark, sf_dir):
    """Log events as JSON lines, then typed; keys without a value are absent from the JSON."""
    raw = _log(spark, sf_dir).select(F.to_json(F.struct("*")).alias("line"))
    rows = L.run_log_rows(raw)
    return rows.select("run_id", "step", *[F.round(c, 6).alias(c) for c in ("loss", "learning_rate", "epoch")])


@query(
    f"""WITH {RUN_LOG} SELECT run_id, count(*) AS n_events, max(step) AS total_steps,
  (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS duration_seconds,
  round(arg_max(loss, step) FILTER (loss IS NOT NULL), 6) AS final_loss, round(min(loss), 6) AS best_loss,
  round(arg_min(learning_rate, step) FILTER (learning_rate IS NOT NULL), 6) AS initial_learning_rate,
  round(arg_max(learning_rate, step) FILTER (learning_rate IS NOT NULL), 6) AS final_learning_rate,
  round(max(epoch), 6) AS final_epoch FROM run_log GROUP BY 1"""
)
def run_summary(spark, sf_dir):
    out = L.run_summary(_log(spark, sf_dir), "run_id").drop("started", "ended")
    rounded = ("final_loss", "best_loss", "initial_learning_rate", "final_learning_rate", "final_epoch")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    f"""WITH {RUN_LOG} SELECT run_id, step, round(avg(loss) OVER (PARTITION BY run_id ORDER BY step
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_avg_loss FROM run_log WHERE loss IS NOT NULL"""
)
def moving_average_loss(spark, sf_dir):
    out = L.moving_average_loss(_log(spark, sf_dir), 10, "run_id", "step")
    return out.select("run_id", "step", F.round("moving_avg_loss", 6).alias("moving_avg_loss"))


@query(
    """SELECT user_id AS run_id, event_id % 2 AS device, round(max(value), 6) AS peak_vram,
  round(max(value * 2), 6) AS peak_utilization, count(*) AS n
FROM (SELECT user_id, event_id, value FROM events
      UNION ALL SELECT user_id, event_id + 1, value / 4 FROM events) GROUP BY 1, 2"""
)
def device_metrics(spark, sf_dir):
    """Nested device logs, one document per event with two devices, back to rows and peaks."""
    def device(number, share):
        vram = F.col("value") * share
        return F.struct(
            (number % 2).cast("int").alias("device"), vram.alias("vram_used"), (vram * 2).alias("utilization")
        )

    reading = F.struct(
        F.col("event_id").cast("string").alias("timestamp"),
        F.array(device(F.col("event_id"), 1.0), device(F.col("event_id") + 1, 0.25)).alias("metrics"),
    )
    nested = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.array(reading).alias("gpu_metrics"))
    devices = L.device_metrics(nested, "run_id")
    peaks = devices.groupBy("run_id", "device").agg(
        F.max("vram_used").alias("peak_vram"), F.max("utilization").alias("peak_utilization"), F.count("*").alias("n")
    )
    return peaks.withColumns({c: F.round(c, 6) for c in ("peak_vram", "peak_utilization")})


@query(
    """SELECT user_id AS run_id, round(max(value), 6) AS peak_vram, round(max(value * 2), 6) AS peak_utilization
FROM events GROUP BY 1"""
)
def device_peaks(spark, sf_dir):
    devices = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("value").alias("vram_used"), (F.col("value") * 2).alias("utilization")
    )
    return L.device_peaks(devices, "run_id").withColumns(
        {c: F.round(c, 6) for c in ("peak_vram", "peak_utilization")}
    )


_ROLLUP = f"""WITH {RUN_LOG} SELECT run_id, step // 50 AS save_interval, count(*) AS n_events, max(step) AS last_step,
  round(min(loss), 6) AS min_loss, round(max(loss), 6) AS max_loss FROM run_log GROUP BY 1, 2"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("min_loss", "max_loss")})


@query(_ROLLUP)
def interval_rollup(spark, sf_dir):
    return _rounded(L.interval_rollup(_log(spark, sf_dir)))


@query(_ROLLUP)
def stream_run_log(spark, sf_dir):
    out = shared_path(spark, "rollup")
    J.stream_run_log(_stream(spark, sf_dir), out, shared_path(spark, "rollup-checkpoint")).awaitTermination()
    return _rounded(J.current_rollup(spark, out))


def _to_the_end(spark, sf_dir, start):
    """Run a stream over the whole log, then once more with a marker that tells it that the log is complete."""
    markers = shared_path(spark, "markers")
    log = _log(spark, sf_dir)
    T.write_end_marker(log, markers, None)
    ends = (None, log.agg(F.max("ts")).first()[0])
    for end in ends:
        if end is not None:
            T.write_end_marker(log, markers, end + timedelta(days=30))
        start(T.with_end_marker(_stream(spark, sf_dir), markers)).awaitTermination()


@query(
    f"""WITH {RUN_LOG} SELECT run_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n_events,
  round(min(loss), 6) AS min_loss, round(max(loss), 6) AS max_loss FROM run_log
GROUP BY run_id, time_bucket(INTERVAL 1 DAY, ts)"""
)
def stream_windows(spark, sf_dir):
    """Daily windows: most are closed by the watermark as the log goes on, the last ones by its end."""
    out, checkpoint = shared_path(spark, "windows"), shared_path(spark, "windows-checkpoint")
    _to_the_end(spark, sf_dir, lambda log: J.stream_windows(log, out, checkpoint))
    days = spark.read.parquet(out).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    return _rounded(days.drop("window_start", "window_end"))


@query(
    f"""WITH {RUN_LOG}, steps AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, step) <= INTERVAL 1 DAY, false) AS goes_on
  FROM run_log), sessions AS (
  SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY run_id ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS session FROM steps)
SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS n_events,
  max(step) AS last_step, round(min(loss), 6) AS min_loss, round(max(loss), 6) AS max_loss,
  round(last(loss ORDER BY ts, step) FILTER (loss IS NOT NULL), 6) AS final_loss FROM sessions GROUP BY run_id, session"""
)
def stream_idle_runs(spark, sf_dir):
    """Sessions of each run, closed by timers a day after their last event; the state of a closed session is gone."""
    out, checkpoint = shared_path(spark, "sessions"), shared_path(spark, "sessions-checkpoint")

    def start(log):
        T.rocksdb_session(log.sparkSession)
        return T.stream_idle_runs(log, out, checkpoint, idle="1 day")

    _to_the_end(spark, sf_dir, start)
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")}
    return _rounded(spark.read.parquet(out)).withColumns(times | {"final_loss": F.round("final_loss", 6)})


@query(f"WITH {RUN_LOG} SELECT run_id, step, round(loss, 6) AS loss FROM run_log WHERE loss IS NOT NULL")
def null_safe_series(spark, sf_dir):
    series = L.select_series(_log(spark, sf_dir), ["run_id", "step", "loss"])
    return series.withColumn("loss", F.round("loss", 6))
