"""Line corpora: one sample per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import strip

# The corpus used when the source has no line at all.
FALLBACK_LINES = ["anna", "bob", "carol", "david", "emma", "frank"]


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty line of ``text``; ``line_no`` counts the lines kept."""
    keep = [c for c in df.columns if c != text]
    lines = F.filter(F.split(F.col(text), "[\r\n]+"), lambda x: x != "")
    return df.select(*keep, F.posexplode(lines).alias("line_no", "line"))


def drop_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    """Without the lines that hold whitespace only."""
    return lines.where(strip(F.col(line)) != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of text files, each with the file it came from."""
    return (
        spark.read.text(path)
        .where(F.col("value") != "")
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    )


def with_fallback(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines, or the fallback corpus where there is none."""
    spark = lines.sparkSession
    present = lines.limit(1).agg(F.count("*").alias("n")).scalar()
    fallback = spark.createDataFrame([(x,) for x in FALLBACK_LINES], f"{line} string")
    return lines.select(line).unionByName(fallback.where(present == 0))
