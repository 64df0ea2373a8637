"""Every registered query runs, and equals its SQL equivalent where it has one."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as registry
from lexiloom.plans.registry import ORACLE, QUERIES
from check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMALL, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["split", "n_examples", "loss"]
    assert df.count() == 2
