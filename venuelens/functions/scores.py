"""Scalar score conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuelens.functions.rounding import exact_round, scaled_round


def score_to_ten(compound: Column) -> Column:
    """[-1, 1] to [0, 10] with one decimal."""
    return exact_round((compound + F.lit(1.0)) / F.lit(2.0) * F.lit(10.0), 1)


def unit_score(score: Column) -> Column:
    """0-10 to 0-1."""
    return score.cast("double") / F.lit(10.0)


def signed_score(label: Column, probability: Column) -> Column:
    """A classifier's (label, probability): positive stays, anything else is negated."""
    return F.when(label == "POSITIVE", probability).otherwise(-probability)


def distance_to_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def percent(similarity: Column) -> Column:
    """A similarity in percent with one decimal."""
    return scaled_round(similarity * F.lit(100.0), 1)


def get_or(map_col: Column, key: str, default: float) -> Column:
    """``map[key]``, or the default when the key (or the map) is missing."""
    return F.coalesce(F.try_element_at(map_col, F.lit(key)), F.lit(default))


def omit_missing(map_col: Column) -> Column:
    """The map without entries whose value is null."""
    return F.map_filter(map_col, lambda _, v: v.isNotNull())
