import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from colloquy.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "colloquy-tests", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named strings."""

    def value(expression, **texts):
        names = list(texts) or ["_"]
        df = spark.createDataFrame([tuple(texts.values()) or ("",)], ", ".join(f"{n} string" for n in names))
        return df.select(expression.alias("v")).first()["v"]

    return value
