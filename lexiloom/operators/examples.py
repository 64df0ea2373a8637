"""Next-token examples of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.ids import next_token_arrays
from lexiloom.operators.kernels import next_token_batches


def example(tokens: Column, marker: Column, block: int | None = None) -> Column:
    """Inputs and targets of one document, the marker being both begin and end.

    A document of ``n`` tokens has ``n + 1`` targets. With ``block``, only the first ``block`` are
    kept, and the end marker is a target only where all of them fit.
    """
    marker = F.array(marker)
    inputs, targets = F.concat(marker, tokens), F.concat(tokens, marker)
    if block is not None:
        inputs, targets = F.slice(inputs, 1, block), F.slice(targets, 1, block)
    return F.struct(inputs.alias("inputs"), targets.alias("targets"))


def doc_examples(
    docs: DataFrame, tokens: str, marker: Column, block: int | None = None
) -> DataFrame:
    """Replace ``tokens`` by ARRAY columns ``inputs`` and ``targets``."""
    return (
        docs.withColumn("_example", example(F.col(tokens), marker, block))
        .withColumns({"inputs": F.col("_example.inputs"), "targets": F.col("_example.targets")})
        .drop("_example", tokens)
    )


def explode_examples(examples: DataFrame) -> DataFrame:
    """One row per target: position, input id and target id."""
    keep = [c for c in examples.columns if c not in ("inputs", "targets")]
    return examples.select(
        *keep,
        F.posexplode(F.arrays_zip("inputs", "targets")).alias("pos", "_e"),
    ).select(*keep, "pos", F.col("_e.inputs").alias("input_id"), F.col("_e.targets").alias("target_id"))


def next_token_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, next_token, n): how often each id follows each other id within a row; no id becomes a row."""
    shifted = docs.where(F.col(tokens).isNotNull()).select(next_token_arrays(F.col(tokens)).alias("e"))
    tallied = shifted.select("e.inputs", "e.targets").mapInArrow(
        next_token_batches, "token int, next_token int, n bigint"
    )
    return tallied.groupBy("token", "next_token").agg(F.sum("n").alias("n"))
