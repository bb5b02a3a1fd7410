"""The recommendation form: facets, preferences, ranking, analysis columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.operators.filters import facet_filter
from venuelens.operators.recommend import FACETS, attach_venues, recommend
from venuelens.plans.analysis import shown_analysis


def recommend_enriched(
    venues: DataFrame, prefs: DataFrame, analysis: DataFrame, k: int = 5, **options
) -> DataFrame:
    """Matches with the venue's columns and its analysis; ``rank`` carries the order."""
    matches = recommend(venues, prefs, k, **options)
    return attach_venues(matches, venues).join(shown_analysis(analysis), "cafe_id")


def submit_form(
    venues: DataFrame,
    prefs: DataFrame,
    analysis: DataFrame,
    outdoor: bool = False,
    quiet: bool = False,
    wifi: bool = False,
    k: int = 5,
) -> DataFrame:
    """What submitting the form gives: facet filters, own budget only, five matches.

    The switches hold for all users; columns ``want_outdoor``, ``want_quiet`` and
    ``want_wifi`` of ``prefs`` are each user's own boxes.
    """
    pool = facet_filter(venues, outdoor=outdoor, quiet=quiet, wifi=wifi)
    return recommend_enriched(pool, prefs, analysis, k, match_budget=True, match_facets=any(c in prefs.columns for c in FACETS))


def match_counts(matches: DataFrame, prefs: DataFrame | None = None) -> DataFrame:
    """How many matches each user got; with ``prefs`` also the users without any, who are shown "no match"."""
    counts = matches.groupBy("user_id").agg(F.count("*").alias("n_matches"))
    if prefs is None:
        return counts
    users = prefs.select("user_id").distinct()
    return users.join(counts, "user_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("bigint")))
