"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a vector of length zero stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector has length zero."""
    return distance_of(dot(a, b), norm(a) * norm(b))


def distance_of(product: Column, lengths: Column) -> Column:
    """From a dot product and the product of the lengths."""
    return F.when(lengths == 0, F.lit(1.0)).otherwise(1 - product / lengths)


def dimension_ok(a: Column, dim: int | Column) -> Column:
    return a.isNotNull() & (F.size(a) == dim)
