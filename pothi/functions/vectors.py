"""Vector expressions; products are accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the guard that keeps zero vectors at 0."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def similarity_of_distance(distance: Column) -> Column:
    """Cosine distance as a similarity between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))
