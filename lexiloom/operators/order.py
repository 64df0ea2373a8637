"""Global order without a global sort: hash buckets, bucket totals and a running value in each.

Keys are MD5 texts, so the leading hex digits split any table into even buckets. Only the bucket
totals (at most ``16 ** DIGITS`` rows) ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.draws import draw, shuffle_key

DIGITS = 4
RANGES = 4096

_TOTALS = {
    "sum": lambda value, order: F.sum(value),
    "min": lambda value, order: F.min(value),
    "last": lambda value, order: F.max_by(value, order),
}
_RUNNING = {
    "sum": F.sum,
    "min": F.min,
    "last": lambda value: F.last(value, ignorenulls=True),
}
_COMBINED = {
    "sum": lambda carry, inner: F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0)),
    "min": lambda carry, inner: F.least(carry, inner),
    "last": lambda carry, inner: F.coalesce(inner, carry),
}


def running(
    df: DataFrame,
    how: str,
    value: Column,
    bucket: Column,
    order: list[str],
    by: tuple[str, ...] = (),
    name: str = "running",
    few_buckets: bool = False,
) -> DataFrame:
    """Add ``how`` (sum, min or last) of ``value`` over all earlier rows, own row excluded.

    ``bucket`` must grow with ``order``. Each bucket is one window group; the carry between
    buckets is computed from one total per bucket.
    """
    keyed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sequence = F.struct(*[F.col(c) for c in order])
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = (
        keyed.groupBy(*by, "_bucket")
        .agg(_TOTALS[how](F.col("_value"), sequence).alias("_total"))
        .select(*by, "_bucket", _RUNNING[how](F.col("_total")).over(over_buckets).alias("_carry"))
    )
    carries = F.broadcast(carries) if few_buckets else carries
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        keyed.join(carries, [*by, "_bucket"])
        .withColumn(
            name,
            _COMBINED[how](F.col("_carry"), _RUNNING[how](F.col("_value")).over(in_bucket)),
        )
        .drop("_bucket", "_value", "_carry")
    )


def range_bucket(df: DataFrame, column: str) -> Column:
    """Number of the equal part of the column's own range that a row is in, so that any spread of keys is cut."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low = ends.select("low").scalar()
    width = ends.select(F.greatest((F.col("high") - F.col("low") + 1) / RANGES, F.lit(1e-9))).scalar()
    return F.floor((F.col(column) - low) / width)


def with_offsets(
    df: DataFrame,
    key: str,
    weight: Column | None = None,
    seed: int | str = 42,
    name: str = "pos",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Add the summed ``weight`` (by default the number) of all rows before this in shuffle order.

    With ``by``, each of its few values (such as the splits) has an order of its own.
    """
    ordered = df.withColumn("_key", shuffle_key(F.col(key), seed))
    weight = F.lit(1) if weight is None else weight
    return running(
        ordered,
        "sum",
        weight.cast("bigint"),
        F.substring("_key", 1, DIGITS),
        ["_key", key],
        by,
        name=name,
        few_buckets=True,
    ).drop("_key")


def shuffled(df: DataFrame, key: str, seed: int | str = 42, limit: int | None = None) -> DataFrame:
    """Add the row's position ``pos`` in the seeded shuffle; optionally keep the first ``limit``."""
    out = with_offsets(df, key, seed=seed)
    return out if limit is None else out.where(F.col("pos") < limit)


def first_in_order(df: DataFrame, key: str, size: int, seed: int | str = 42) -> DataFrame:
    """The first ``size`` rows of the shuffle: a top-k, no full sort."""
    return df.orderBy(shuffle_key(F.col(key), seed), F.col(key)).limit(size)


def _cut(df: DataFrame, key: str, size: Column, seed: int | str) -> Column:
    """(shuffle key, id) of the row at position ``size - 1``; NULL for size 0.

    Bucket counts find the bucket that holds it, and only that bucket is ranked. The text of the
    rows is never moved.
    """
    keys = df.select(shuffle_key(F.col(key), seed).alias("k"), F.col(key).alias("id"))
    keys = keys.withColumn("b", F.substring("k", 1, DIGITS))
    counts = keys.groupBy("b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    bucket = (
        counts.withColumn("upto", upto)
        .where((F.col("upto") - F.col("n") < size) & (size <= F.col("upto")))
        .select("b", (F.col("upto") - F.col("n")).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("b").orderBy("k", "id"))
    return (
        keys.join(F.broadcast(bucket), "b")
        .withColumn("rank", rank + F.col("before"))
        .where(F.col("rank") == size)
        .agg(F.first(F.struct("k", "id")).alias("cut"))
        .scalar()
    )


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("n")).scalar()


def split_head(
    df: DataFrame, key: str, ratio: float = 0.05, seed: int | str = 42, name: str = "split"
) -> DataFrame:
    """The first ``max(1, int(n * ratio))`` rows of the shuffle are ``eval``, the others ``train``."""
    if not 0.0 < ratio < 0.5:
        raise ValueError("ratio must be between 0 and 0.5")
    size = F.greatest(F.lit(1), F.floor(_row_count(df) * F.lit(ratio))).cast("bigint")
    row = F.struct(shuffle_key(F.col(key), seed).alias("k"), F.col(key).alias("id"))
    return df.withColumn(
        name, F.when(row <= _cut(df, key, size, seed), "eval").otherwise("train")
    )


def split_tail(
    df: DataFrame, key: str, seed: int | str = 42, name: str = "split"
) -> DataFrame:
    """The last tenth of the shuffle (at least one row of two or more) is ``val``."""
    n = _row_count(df)
    held_out = F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 10)))
    row = F.struct(shuffle_key(F.col(key), seed).alias("k"), F.col(key).alias("id"))
    return df.withColumn(
        name,
        F.when(row <= _cut(df, key, (n - held_out).cast("bigint"), seed), "train").otherwise("val"),
    )


def draw_rows(draws: DataFrame, draw_key: str, df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """One row of ``df`` for each draw, with replacement: (``draw_key``, ``key``)."""
    positions = shuffled(df.select(key), key)
    drawn = draws.select(draw_key, draw(F.col(draw_key), _row_count(df), seed).alias("pos"))
    return drawn.join(positions, "pos").select(draw_key, key)
