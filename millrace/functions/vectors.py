"""Vector expressions on array columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """0 where lengths differ or a norm is 0; null for a null vector."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)
