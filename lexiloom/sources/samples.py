"""Framed samples. They hold line breaks, so plain line-by-line text would tear them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SEPARATOR = "\x1e"


def write_samples(samples: DataFrame, path: str, text: str = "sample", form: str = "text") -> None:
    """``parquet`` keeps all columns, such as key and split; ``text`` holds one sample per record.

    Text records end with U+001E, so a sample that holds that sign itself is refused.
    """
    writer = samples.write.mode("errorifexists")
    if form == "parquet":
        writer.parquet(path)
        return
    if form != "text":
        raise ValueError("form must be parquet or text")
    torn = F.raise_error(F.lit("a sample holds the record separator; write parquet"))
    whole = F.when(F.col(text).contains(RECORD_SEPARATOR), torn.cast("string")).otherwise(F.col(text))
    samples.select(whole.alias(text)).write.mode("errorifexists").option("lineSep", RECORD_SEPARATOR).text(path)


def read_samples(spark: SparkSession, path: str, text: str = "sample", form: str = "text") -> DataFrame:
    if form == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("lineSep", RECORD_SEPARATOR).text(path).withColumnRenamed("value", text)
