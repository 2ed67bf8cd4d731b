"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the driver tables, BENCH_CPUS the number of local cores. Every
query is run to its last row through the noop sink; the first, untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from colloquy.plans.registry import all_queries
from colloquy.session import local_session

HEADLINES = (
    "summary_stats",
    "label_summary",
    "melt_ratings",
    "score_distribution",
    "low_rated_verdict",
    "checkpoint_score",
    "best_checkpoint",
    "score_quartiles",
    "improvement_from_base_best",
    "transcript_round_trip",
    "extract_pairs",
    "py_strip",
    "chat_windows",
    "example_checks",
    "prepared_examples",
    "token_budget",
    "tokenize_pad",
    "pattern_hits",
    "pattern_span_mask",
    "train_eval_split",
    "fill_template",
    "history_window",
    "context_length",
    "parse_two_metric",
    "parse_four_metric",
    "upsert_ratings",
    "flag_duplicates",
    "drop_duplicates_keep_first",
    "run_summary",
    "moving_average_loss",
    "stream_run_log",
    "stream_transcripts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "colloquy-bench", tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()

    def seconds(name: str) -> float:
        start = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds(HEADLINES[0])
    timings = {name: seconds(name) for name in HEADLINES}
    report = {
        "metric": "headline queries, wall time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
