"""Loss and evaluation logs as CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.sources.versions import append_version, read_versions

LOSSES = "step int, loss double"
EVALUATIONS = "step int, train_loss double, val_loss double, lr double"


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str = LOSSES) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_steps(log: DataFrame, path: str, run: str, schema: str = LOSSES) -> int:
    """Add steps of ``run`` to a log that is resumed: a step that is there already will be replaced, none is doubled."""
    columns = StructType.fromDDL(schema).names
    return append_version(log.select(*columns, F.lit(run).alias("run")), path, "csv", header=True)


def read_steps(spark: SparkSession, path: str, schema: str = LOSSES, upto: int | None = None) -> DataFrame:
    """One row per run and step, as it was written last; of equal steps of one write, the largest values."""
    rows = read_versions(spark, path, f"{schema}, run string", "csv", upto, header=True)
    columns = StructType.fromDDL(schema).names
    latest = rows.groupBy("run", F.col("step").alias("_step")).agg(F.max(F.struct("version", *columns)).alias("r"))
    return latest.select("run", *[F.col(f"r.{c}").alias(c) for c in columns])
