"""Vectors held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no direction."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def unit(a: Column) -> Column:
    """``a`` at length 1; null without a direction.

    The length is repeated into an array of its own: inside a lambda it would be worked
    out again for every place.
    """
    length = norm(a)
    return F.when(length > 0, F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, n: x / n))
