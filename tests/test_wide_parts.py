"""Wide ratings of a dialogue of more than four pairs."""

from oracle import compare, duck
from test_long_dialogues import pytestmark, tables  # noqa: F401

import __spark_entry__ as driver
from colloquy.operators import analytics as A


def test_wide_parts_hold_all_pairs(spark, tables):  # noqa: F811
    parts = driver.queries()["ratings_in_parts"](spark, tables)
    _, differences = compare(parts, duck(tables), driver.oracle_sql()["ratings_in_parts"])
    assert not differences, "\n".join(differences)
    long = parts.filter("dialogue_id = 900001").drop("model_version", "checkpoint")
    rows = A.melt_ratings(long, ["dialogue_id"], part_width=4).filter("score IS NOT NULL").collect()
    assert {r["pair_num"] for r in rows} == set(range(1, 651)) and len(rows) == 4 * 650
