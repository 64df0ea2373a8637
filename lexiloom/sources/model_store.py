"""Count models on disk: a parquet table and the configuration it was learned with."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.versions import append_version, read_versions, versions

# Fields added later have a default, so that models saved without them still load.
CONFIG_DEFAULTS = {
    "model_order": None,
    "base": None,
    "pad": None,
    "end": None,
    "vocab_size": None,
    "weighting": "token",
    "seed": 42,
}


def complete(config: dict) -> dict:
    unknown = set(config) - set(CONFIG_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown configuration fields: {sorted(unknown)}")
    return {**CONFIG_DEFAULTS, **config}


def save_model(counts: DataFrame, config: dict, path: str) -> None:
    spark = counts.sparkSession
    counts.write.partitionBy("model_order").parquet(f"{path}/counts")
    row = spark.createDataFrame([(json.dumps(complete(config)),)], "value string")
    row.coalesce(1).write.text(f"{path}/config.json")


def append_model(counts: DataFrame, config: dict, path: str) -> int:
    """Add the counts of further documents to a saved model of the same settings, and return their version."""
    _refuse_other(counts.sparkSession, path, config)
    return append_version(counts.select("model_order", "context", "next", "n"), f"{path}/more")


def _refuse_other(spark: SparkSession, path: str, wanted: dict) -> None:
    saved = complete(json.loads(spark.read.text(f"{path}/config.json").first()["value"]))
    wanted = complete(wanted)
    differing = [k for k in CONFIG_DEFAULTS if saved[k] != wanted[k]]
    if differing:
        raise ValueError(f"the model was learned with other settings: {', '.join(differing)}")


def load_model(spark: SparkSession, path: str, wanted: dict) -> DataFrame:
    """The count table, with all that was added; ``ValueError`` if any setting differs from ``wanted``."""
    _refuse_other(spark, path, wanted)
    counts = spark.read.parquet(f"{path}/counts").select("model_order", "context", "next", "n")
    if not versions(f"{path}/more"):
        return counts
    kind = counts.schema["n"].dataType.simpleString()
    more = read_versions(spark, f"{path}/more", f"model_order int, context bigint, next int, n {kind}")
    return counts.unionByName(more.drop("version")).groupBy("model_order", "context", "next").agg(F.sum("n").alias("n"))


def differing_fields(saved: Column, wanted: Column, fields: list[str]) -> Column:
    """Names of the STRUCT fields that differ, NULL equalling NULL only."""
    flags = [F.when(~saved[f].eqNullSafe(wanted[f]), F.lit(f)) for f in fields]
    return F.array_compact(F.array(*flags))
