"""Row-local vector expressions over array<float> or array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO = 1e-8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def all_near_zero(a: Column) -> Column:
    return F.forall(a, lambda x: F.abs(x) <= NEAR_ZERO)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when either vector is (almost) all zeros."""
    return F.when(all_near_zero(a) | all_near_zero(b), F.lit(0.0)).otherwise(
        dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    )


def softmax(scores: Column, scale: float = 3.0) -> Column:
    """Probabilities from ``exp(scale * score)``."""
    weights = F.transform(scores, lambda s: F.exp(s * F.lit(scale)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda w: w / total)


def first_argmax(values: Column) -> Column:
    """Position (from 1) of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int")
