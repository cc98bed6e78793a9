"""Vector arithmetic as column functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    return F.transform(v, lambda x: x / F.when(norm(v) == 0, 1.0).otherwise(norm(v)))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)
