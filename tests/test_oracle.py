"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from oracle import compare, duck

import __spark_entry__ as driver
from colloquy.plans.registry import all_queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    n_rows, differences = compare(driver.queries()[name](spark, SF_DIR), con, driver.oracle_sql()[name])
    assert not differences, "\n".join(differences)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
