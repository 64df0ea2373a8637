"""Normalisation and softmax over ARRAY columns, in DOUBLE throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.draws import bind

NORM_EPS = 1e-5


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def rms_norm(vector: Column) -> Column:
    v = doubles(vector)
    mean_square = total(F.transform(v, lambda x: x * x)) / F.size(v)
    return bind(F.sqrt(mean_square + F.lit(NORM_EPS)), lambda s: F.transform(v, lambda x: x / s))


def layer_norm(vector: Column) -> Column:
    v = doubles(vector)
    centred = bind(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))

    def scaled(c: Column) -> Column:
        spread = total(F.transform(c, lambda x: x * x)) / F.size(c)
        return bind(F.sqrt(spread + F.lit(NORM_EPS)), lambda s: F.transform(c, lambda x: x / s))

    return bind(centred, scaled)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Scale, subtract the maximum, exponentiate and divide by the (floored) sum."""
    scaled = F.transform(doubles(logits), lambda x: x / F.lit(max(temperature, 1e-4)))
    exps = bind(
        scaled,
        lambda v: bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))),
    )
    return bind(
        exps,
        lambda e: bind(
            F.greatest(total(e), F.lit(1e-9)), lambda s: F.transform(e, lambda x: x / s)
        ),
    )
