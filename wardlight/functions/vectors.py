"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda s, x: s + x * x))


def l2(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    # the length is bound once by the outer lambda, not computed per element
    scaled = F.transform(
        F.array(norm(vector)),
        lambda n: F.transform(as_double(vector), lambda x: F.when(n > 0, x / n).otherwise(x)),
    )
    return F.element_at(scaled, 1)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )
    return 1 - dot / (norm(a) * norm(b))
