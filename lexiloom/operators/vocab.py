"""Byte vocabulary: learning, encoding, decoding and the check for unknown bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import byte_ids, utf8
from lexiloom.operators.kernels import byte_count_batches


def byte_counts(docs: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """Occurrences of each byte value, optionally per group."""
    group = F.lit("") if by is None else F.col(by)
    kind = "string" if by is None else docs.schema[by].dataType.simpleString()
    counts = docs.select(group.alias("grp"), text).mapInArrow(
        byte_count_batches, f"grp {kind}, byte int, n bigint"
    )
    keys = [] if by is None else [F.col("grp").alias(by)]
    return counts.groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def byte_vocab(docs: DataFrame, text: str = "text") -> DataFrame:
    """Dense ids in byte order; the last id is the begin/end marker, whose byte is NULL."""
    seen = byte_counts(docs, text)
    # at most 256 rows
    by_byte = Window.orderBy("byte")
    ids = seen.select((F.row_number().over(by_byte) - 1).alias("token_id"), "byte", "n")
    marker = seen.agg(F.count("*").cast("int").alias("token_id")).select(
        "token_id", F.lit(None).cast("int").alias("byte"), F.lit(0).cast("bigint").alias("n")
    )
    return ids.unionByName(marker)


def _id_by_byte(vocab: DataFrame) -> Column:
    """256-entry array: the id of each byte, NULL where the vocabulary lacks it."""
    known = vocab.where(F.col("byte").isNotNull())
    entries = known.agg(F.map_from_entries(F.collect_list(F.struct("byte", "token_id"))).alias("m"))
    return entries.select(
        F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.try_element_at(F.col("m"), b)).alias("ids")
    ).scalar()


def _hex_by_id(vocab: DataFrame) -> Column:
    byte_hex = F.lpad(F.hex(F.col("byte")), 2, "0")
    ordered = F.array_sort(F.collect_list(F.struct("token_id", F.coalesce(byte_hex, F.lit("")).alias("h"))))
    return vocab.agg(F.transform(ordered, lambda e: e["h"]).alias("hexes")).scalar()


def encode_bytes(docs: DataFrame, vocab: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
    """Add the ids of the text's bytes; NULL marks a byte that the vocabulary lacks."""
    return docs.withColumn("_ids", _id_by_byte(vocab)).withColumn(
        name, F.transform(byte_ids(utf8(F.col(text))), lambda b: F.get(F.col("_ids"), b))
    ).drop("_ids")


def decode_bytes(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", name: str = "data") -> DataFrame:
    """Add the bytes of the ids as BINARY."""
    return docs.withColumn("_hexes", _hex_by_id(vocab)).withColumn(
        name,
        F.unhex(F.array_join(F.transform(F.col(tokens), lambda t: F.get(F.col("_hexes"), t)), "")),
    ).drop("_hexes")


def unsupported_bytes(prompts: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The bytes of each prompt that the vocabulary lacks: (``key``, ``byte``)."""
    used = prompts.select(key, F.explode(F.array_distinct(byte_ids(utf8(F.col(text))))).alias("byte"))
    known = vocab.where(F.col("byte").isNotNull()).select("byte")
    return used.join(F.broadcast(known), "byte", "left_anti").select(key, "byte")


def reject_unsupported(prompts: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Only the prompts whose bytes the vocabulary covers."""
    return prompts.join(unsupported_bytes(prompts, vocab, key, text), key, "left_anti")


def corpus_stats(docs: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """Documents and bytes per split and in total, with the vocabulary size."""
    size = byte_counts(docs, text).agg((F.count("*") + 1).alias("n")).scalar()
    per_split = docs.groupBy(split).agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length(text)).cast("bigint").alias("n_tokens")
    )
    return (
        per_split.rollup(split)
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .select(F.coalesce(split, F.lit("all")).alias("split"), "n_docs", "n_tokens", size.alias("vocab_size"))
    )


def encoded_stats(encoded: DataFrame, split: str, tokens: str, text: str) -> DataFrame:
    """Samples, tokens, token range per sample and bytes of each split of encoded texts; no token becomes a row."""
    sized = encoded.select(split, F.size(tokens).alias("n"), F.octet_length(text).alias("size"))
    return sized.groupBy(split).agg(
        F.count("*").alias("n_samples"),
        F.sum("n").cast("bigint").alias("n_tokens"),
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.sum("size").cast("bigint").alias("n_bytes"),
        F.try_divide(F.sum("size"), F.sum("n")).cast("double").alias("bytes_per_token"),
    )
