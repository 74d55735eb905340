"""Vector and probability functions over arrays, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The unit vector; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(F.array(total(shifted)), lambda z: F.transform(shifted, lambda x: x / z))[0]  # the sum once


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    log_sum = F.log(total(F.transform(logits, lambda x: F.exp(x - top)))) + top
    return F.transform(F.array(log_sum), lambda z: F.transform(logits, lambda x: x - z))[0]


def finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_probabilities(values: Column, n: int, tolerance: float = 1e-5) -> Column:
    """n finite values from 0 to 1 that sum to 1 within the tolerance."""
    inside = F.forall(values, lambda x: (x >= 0) & (x <= 1))
    return F.coalesce((F.size(values) == n) & finite(values) & inside & (F.abs(total(values) - 1) <= tolerance), F.lit(False))
