"""Registered queries: a name, the Spark job, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


def all_queries() -> dict[str, Query]:
    from colloquy.plans import (  # noqa: F401  (importing registers)
        analytics_queries,
        config_queries,
        example_queries,
        file_queries,
        prompt_queries,
        rating_queries,
        runlog_queries,
        transcript_queries,
    )

    return QUERIES
