"""Runs a registered query in Spark and its SQL in DuckDB, and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark_df, con, sql):
    """``(n_rows, differences)``; differences is empty when columns and rows agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = rows(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return 0, [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    actual = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    diffs = []
    if len(actual) != len(expected):
        diffs.append(f"{len(actual)} rows, expected {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    for a, e in wrong[:2]:
        diffs.append(f"columns {sorted(names)}\n   spark {a}\n   duck  {e}")
    if wrong:
        diffs.append(f"{len(wrong)} rows differ")
    kinds = {n: (t.simpleString(), types[n]) for n, t in ((f.name, f.dataType) for f in spark_df.schema)}
    for n, (s, d) in kinds.items():
        s_kind = "num" if s in ("int", "bigint", "double", "float") else s
        d_kind = "num" if d in ("INTEGER", "BIGINT", "DOUBLE", "FLOAT") else {"VARCHAR": "string", "BOOLEAN": "boolean"}.get(d, d)
        if s_kind != d_kind:
            diffs.append(f"type of {n}: {s} and {d}")
    return len(actual), diffs
