from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # names that operators use inside
        T.StructField("k1", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("mark", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) with further columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", None, 1, 0.5) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make
