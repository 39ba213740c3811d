"""Vector functions on array columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return F.when(norm(a) * norm(b) == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def normalized(a: Column) -> Column:
    # The norm is a lambda's variable, so that it is computed once and not for each element.
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / (n + F.lit(EPSILON)))), 1)


def has_dim(a: Column, dim: int) -> Column:
    return F.coalesce(F.size(a) == dim, F.lit(False))
