"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def needs_spread(df: DataFrame) -> bool:
    """Whether there are fewer partitions than cores."""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute a scan that has fewer splits than cores; leave a large one as it is."""
    if not needs_spread(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
