"""One long token stream laid out from many documents, and windows drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.draws import draw
from lexiloom.functions.text import byte_ids, utf8
from lexiloom.operators.order import with_offsets

# Positions of the stream in one range that windows and documents are matched by.
STREAM_RANGE = 1 << 16


def token_stream(
    docs: DataFrame,
    key: str,
    n_tokens: Column,
    eos: bool = False,
    seed: int | str = 42,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``n_tokens``, ``first_idx`` and ``last_idx`` of each document in shuffle order.

    With ``eos``, one end token follows each document and counts as its last.
    """
    n = n_tokens + 1 if eos else n_tokens
    sized = docs.withColumn("n_tokens", n.cast("bigint"))
    return with_offsets(sized, key, F.col("n_tokens"), seed, "first_idx", by).withColumn(
        "last_idx", F.col("first_idx") + F.col("n_tokens") - 1
    )


def with_end_token(docs: DataFrame, tokens: str, end_id: int) -> DataFrame:
    """The end token after each document's own, which ``token_stream(eos=True)`` leaves room for."""
    return docs.withColumn(tokens, F.array_append(tokens, F.lit(end_id)))


def stream_blocks(stream: DataFrame, tokens: str, block: int) -> DataFrame:
    """The stream cut at multiples of ``block``: (block_no, idx, tokens), pieces of a block in order.

    No piece is longer than a block, however long its document is.
    """
    first, last = F.col("first_idx"), F.col("last_idx")

    def piece(b: Column) -> Column:
        lo = F.greatest(first, b * block)
        hi = F.least(last + 1, (b + 1) * block)
        return F.struct(
            b.alias("block_no"),
            lo.alias("idx"),
            F.slice(F.col(tokens), (lo - first + 1).cast("int"), (hi - lo).cast("int")).alias("tokens"),
        )

    numbers = F.sequence(F.floor(first / block).cast("bigint"), F.floor(last / block).cast("bigint"))
    return (
        stream.where(F.col("n_tokens") > 0)
        .select(F.explode(F.transform(numbers, piece)).alias("p"))
        .select("p.*")
    )


def window_draws(draws: DataFrame, key: str, total: Column, block: int, seed: int | str) -> DataFrame:
    """For each draw a window of ``n = min(block, total - 1)`` inputs, start uniform over all fits."""
    n = F.least(F.lit(block).cast("bigint"), total - 1)
    return (
        draws.select(key, n.alias("n"), total.alias("_total"))
        .where(F.col("n") > 0)
        .select(key, draw(F.col(key), F.col("_total") - F.col("n"), seed).alias("start_idx"), "n")
    )


def sample_byte_windows(stream: DataFrame, docs: DataFrame, key: str, text: str, draws: DataFrame, draw_key: str) -> DataFrame:
    """The ``n + 1`` bytes of each drawn window of the byte stream, as ``tokens``.

    ``stream(key, first_idx, last_idx)`` holds no text: ranges of the stream tell which documents a window
    touches, and only what the windows need is cut from those texts.
    """
    first, last, stop = F.col("first_idx"), F.col("last_idx"), F.col("start_idx") + F.col("n")

    def ranges(low: Column, high: Column) -> Column:
        numbers = F.sequence(F.floor(low / STREAM_RANGE).cast("bigint"), F.floor(high / STREAM_RANGE).cast("bigint"))
        return F.explode(numbers)

    held = stream.where(first <= last).select(key, "first_idx", "last_idx", ranges(first, last).alias("_range"))
    wanted = draws.select(draw_key, "start_idx", "n", ranges(F.col("start_idx"), stop).alias("_range"))
    touched = (
        held.join(wanted, "_range")
        .where((first <= stop) & (last >= F.col("start_idx")))
        .select(draw_key, "start_idx", "n", key, "first_idx", "last_idx")
        .distinct()
    )
    low, high = F.greatest(first, F.col("start_idx")), F.least(last, stop)
    part = F.substring(utf8(F.col(text)), (low - first + 1).cast("int"), (high - low + 1).cast("int"))
    return (
        touched.join(docs.select(key, text), key)
        .select(draw_key, "start_idx", "n", F.struct(low.alias("idx"), part.alias("data")).alias("part"))
        .groupBy(draw_key, "start_idx", "n")
        # at most n + 1 bytes per window
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(draw_key, "start_idx", "n", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["data"])).alias("data"))
        .select(draw_key, "start_idx", "n", byte_ids(F.col("data")).alias("tokens"))
    )


def sample_windows(blocks: DataFrame, draws: DataFrame, key: str, block: int) -> DataFrame:
    """The ``n + 1`` tokens of each drawn window: an equi-join on block numbers, not a range join."""
    start, stop = F.col("start_idx"), F.col("start_idx") + F.col("n") + 1
    wanted = draws.withColumn(
        "block_no",
        F.explode(
            F.sequence(F.floor(start / block).cast("bigint"), F.floor((stop - 1) / block).cast("bigint"))
        ),
    )
    lo = F.greatest(F.col("idx"), start)
    hi = F.least(F.col("idx") + F.size("tokens"), stop)
    part = F.slice(F.col("tokens"), (lo - F.col("idx") + 1).cast("int"), (hi - lo).cast("int"))
    return (
        blocks.join(wanted, "block_no")
        .where(hi > lo)
        .select(key, "start_idx", "n", lo.alias("idx"), part.alias("tokens"))
        .groupBy(key, "start_idx", "n")
        # at most n + 1 tokens per window
        .agg(F.array_sort(F.collect_list(F.struct("idx", "tokens"))).alias("parts"))
        .select(key, "start_idx", "n", F.flatten(F.col("parts.tokens")).alias("tokens"))
    )
