"""Row filters: facets, budget, point lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens import vocab


def facet_condition(
    outdoor: bool = False, quiet: bool = False, wifi: bool = False, **facets
) -> Column:
    """A conjunction of the requested facets; ``None`` means "not asked for".

    The three named switches are the form's check boxes.  ``facets`` adds
    ``column=value`` equalities, e.g. ``open_now=True`` or ``atmosphere='Rooftop'``.
    A null column never passes.
    """
    wanted: dict = {}
    if outdoor:
        wanted["outdoor_seating"] = True
    if quiet:
        wanted["noise_level"] = vocab.QUIET_NOISE_LEVEL
    if wifi:
        wanted["free_wifi"] = True
    wanted.update({c: v for c, v in facets.items() if v is not None})
    return reduce(and_, [F.col(c) == F.lit(v) for c, v in wanted.items()], F.lit(True))


def facet_filter(venues: DataFrame, **facets) -> DataFrame:
    return venues.filter(facet_condition(**facets))


def budget_filter(venues: DataFrame, label: str | None) -> DataFrame:
    """Venues with that budget label; no filter for ``None``, ``''`` and ``'Any'``."""
    if not label or label == vocab.ANY_BUDGET:
        return venues
    return venues.filter(F.col("budget_label") == label)


def venue_names(venues: DataFrame) -> DataFrame:
    """The pick list of names; equal names stay separate entries."""
    return venues.select("name")


def venues_by_name(venues: DataFrame, *names: str) -> DataFrame:
    """The first venue (smallest ``cafe_id``) of each name; of all names when none is given."""
    wanted = venues.filter(F.col("name").isin(*names)) if names else venues
    first = Window.partitionBy("name").orderBy("cafe_id")
    return wanted.withColumn("place_by_name", F.row_number().over(first)).filter("place_by_name = 1").drop("place_by_name")


def reviews_of(reviews: DataFrame, *cafe_ids) -> DataFrame:
    """Reviews of the given venues; a parquet scan gets the filter pushed down."""
    return reviews.filter(F.col("cafe_id").isin(*cafe_ids)) if cafe_ids else reviews
