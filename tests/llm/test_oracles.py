"""Operators that SQL can express, against their SQL: on the smallest tables, and on nulls, ties and repeated rows."""

from pathlib import Path

import pytest
from oracle import compare, duck

from colloquy.llm import queries

SF_DIR = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, " \n\t "), (None, "a b c a b c " * 40), (4, "the of x ... \nthe of x ... \n… … " * 30), (4, "é ü #*$%& | <> " * 20), (5, "w " * 90), (5, "w " * 90)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no driver tables")
def test_tables(spark, name):
    n_rows, differences = compare(queries.QUERIES[name](spark, SF_DIR), duck(SF_DIR), queries.ORACLE_SQL[name])
    assert n_rows and not differences, "\n".join(differences)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_odd_rows(spark, tmp_path, name):
    spark.createDataFrame(ODD, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    differences = compare(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE_SQL[name])[1]
    assert not differences, "\n".join(differences)
