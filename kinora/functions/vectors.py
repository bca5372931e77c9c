"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN for a zero vector, as no division by zero may fail the query."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.when(scale == 0, 1.0).otherwise(scale))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
