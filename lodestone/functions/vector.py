"""Vector expressions on array<float> columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a||b|); NULL when a norm is zero or an input is NULL."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def truncate_and_normalize(a: Column, dim: int) -> Column:
    """First ``dim`` components, scaled to unit length after the cut."""
    head = F.slice(a, 1, dim)
    # The one-element array binds the norm once, so it is not recomputed per component.
    scaled = F.transform(F.array(norm(head)), lambda length: F.transform(
        head, lambda x: F.try_divide(x.cast("double"), length).cast("float")))
    return scaled[0]


def has_dim(a: Column, dim: int) -> Column:
    return F.size(a) == dim
