"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def unit(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def similarity_score(cosine: Column) -> Column:
    """Cosine as a score: rounded to four places, held between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(cosine, 4)))
