"""Tables that grow by versions: every append is a folder of its own, which counts once its write has succeeded.

A write that fails, or whose driver is lost, leaves a folder without the marker of success. Readers pass over it, and
the next append takes a later number, so that what was there before stays readable. One writer at a time.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.token_files import file_system

PREFIX = "version="
MARKER = "_SUCCESS"


def _numbers(path: str) -> list[int]:
    """All versions that were begun."""
    files, root = file_system(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(i.base_name[len(PREFIX) :]) for i in found if i.base_name.startswith(PREFIX))


def versions(path: str) -> list[int]:
    """The versions whose write succeeded, the oldest first."""
    files, root = file_system(path)
    numbers = _numbers(path)
    marks = files.get_file_info([f"{root}/{PREFIX}{n}/{MARKER}" for n in numbers])
    return [n for n, mark in zip(numbers, marks) if mark.type == fs.FileType.File]


def append_version(df: DataFrame, path: str, form: str = "parquet", **options) -> int:
    """Write ``df`` as the next version and return its number."""
    number = max(_numbers(path), default=0) + 1
    df.write.format(form).options(**options).save(f"{path}/{PREFIX}{number}")
    return number


def read_versions(
    spark: SparkSession, path: str, schema: str, form: str = "parquet", upto: int | None = None, **options
) -> DataFrame:
    """All rows with their ``version``; with ``upto``, the table as it was after that version."""
    numbers = [n for n in versions(path) if upto is None or n <= upto]
    if not numbers:
        return spark.createDataFrame([], schema).withColumn("version", F.lit(0))
    reader = spark.read.format(form).schema(f"{schema}, version int").option("basePath", path).options(**options)
    return reader.load([f"{path}/{PREFIX}{n}" for n in numbers])
