"""Opening a corpus by its path alone."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lexiloom.sources.lines import read_lines, with_fallback
from lexiloom.sources.token_files import is_token_corpus, load_corpus


def read_corpus(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """``("tokens", rows)`` of a ``.bin`` path with its sidecars, else ``("lines", rows)``.

    A line corpus that is absent or empty is replaced by the fallback corpus.
    """
    if is_token_corpus(path):
        return "tokens", load_corpus(spark, path)[0]
    try:
        lines = read_lines(spark, path).select("line")
    except AnalysisException as error:
        # Spark resolves globs and every scheme that it can read
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "line string")
    return "lines", with_fallback(lines)
