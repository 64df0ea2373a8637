"""Sharding by a Feistel permutation of global row numbers.

Every row gets a dense number. A Feistel network over the smallest even number of bits that holds all
numbers permutes them; numbers that leave the range walk on along their cycle until they return to it. The
permuted number ``p`` of ``n`` is dealt to shard ``p % shards``, slot ``p // shards``, so shard sizes differ
by one row at most, and both the place of a row and the row of a place can be computed from the seed.

Defined results: a null text has size 1 and checksum 0; null ids are ids like any other; equal rows are
numbered one after the other, each with a place of its own; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import numbered, text_or_empty
from lexiloom.shipping import ship

ship(__name__)

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    counters = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(counters + np.uint64(seed & (2**64 - 1)))


def half_bits(n: int) -> int:
    """Bits of each half of the network for numbers below ``n``."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each number below ``n``, or with ``back`` the number at each place."""
    half, keys = half_bits(n), _keys(seed)
    with np.errstate(over="ignore"):
        out = _network(np.asarray(numbers).astype(np.uint64), half, keys, back)
        outside = np.flatnonzero(out >= n)
        while len(outside):
            out[outside] = _network(out[outside], half, keys, back)
            outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 42) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row, under the law ``rows``.

    Only (id, size, checksum) is shuffled, never the text.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    n = df.count()

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return (
        numbered(rows, [], "_number")
        .withColumn("_place", place("_number"))
        .select(
            F.col("doc_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("_place") % shards).cast("int").alias("shard"),
            F.expr(f"_place div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
