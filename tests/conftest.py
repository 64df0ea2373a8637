from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lexiloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of a column expression over one text column ``t``."""

    def run(values, expression, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, t {kind}").select("i", expression.alias("out"))
        return [r["out"] for r in df.orderBy("i").collect()]

    return run
