"""Reproducible draws: every random choice is a hash of the seed and the row's own key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also from inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_key(key: Column, seed: int | str = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def draw(key: Column, below: Column | int, seed: int | str = 42) -> Column:
    """An integer in [0, below), from 32 hash bits where that is enough and 60 beyond."""
    below = F.lit(below).cast("bigint") if isinstance(below, int) else below.cast("bigint")
    digest = shuffle_key(key, seed)
    short = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    long = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.when(below <= F.lit(1 << 24), F.pmod(short, below)).otherwise(F.pmod(long, below))


def fraction(key: Column, seed: int | str = 42) -> Column:
    """A DOUBLE in [0, 1) of 52 hash bits."""
    bits = F.conv(F.substring(shuffle_key(key, seed), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(1 << 52))


def unit_draw(key: Column, seed: int | str = 42) -> Column:
    """A DOUBLE in [0, 1)."""
    return draw(key, 1 << 24, seed) / F.lit(float(1 << 24))


def draw_index(probs: Column, r: Column) -> Column:
    """First zero-based index whose running sum reaches ``r``; the last index if none does."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def step(acc, p):
        total = acc["sum"] + p.cast("double")
        hit = F.when((acc["hit"] < 0) & (r <= total), acc["i"]).otherwise(acc["hit"])
        return F.struct(total.alias("sum"), (acc["i"] + 1).alias("i"), hit.alias("hit"))

    return F.aggregate(
        probs,
        start,
        step,
        lambda acc: F.when(acc["hit"] >= 0, acc["hit"]).otherwise(F.size(probs) - 1),
    )
