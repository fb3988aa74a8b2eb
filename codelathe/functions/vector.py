"""Vector columns: cosine in doubles, by hand, as both engines must agree on zero vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Similarity in [-1, 1]; 0 if a vector is zero, null if the lengths differ."""
    length = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(length, F.lit(0.0))))))


def guarded_cosine(a: Column, b: Column, least_dims: int = 64) -> Column:
    """As :func:`cosine`, but 0 for nulls, different lengths and fewer than ``least_dims`` numbers."""
    return F.coalesce(F.when(F.size(a) >= least_dims, cosine(a, b)), F.lit(0.0))
