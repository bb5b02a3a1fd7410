"""The review drill-down of chosen venues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.operators.filters import venues_by_name
from venuelens.operators.reshape import aspect_rows, score_profile
from venuelens.operators.reviews import review_listing
from venuelens.plans.analysis import analyze


@dataclass(frozen=True)
class VenueReport:
    """The four parts of the drill-down, each keyed by ``cafe_id``."""

    header: DataFrame
    scores: DataFrame
    aspects: DataFrame
    reviews: DataFrame


def report_of(venues: DataFrame, reviews: DataFrame, lexicon: DataFrame | None, *names: str, **options) -> VenueReport:
    """The report with an analysis of the chosen venues' reviews only."""
    chosen = venues_by_name(venues, *names)
    own = reviews.join(chosen.select("cafe_id"), "cafe_id", "left_semi")
    return venue_report(chosen, analyze(chosen, own, lexicon, **options), own)


def venue_report(
    venues: DataFrame, analysis: DataFrame, reviews: DataFrame, *names: str
) -> VenueReport:
    """Reports of the first venue of each given name (of every name when none is given)."""
    chosen = venues_by_name(venues, *names)
    ids = chosen.select("cafe_id")
    header = chosen.join(
        analysis.select("cafe_id", "ai_recommendation_score", "num_reviews", "ai_summary"),
        "cafe_id",
    ).select(
        "cafe_id",
        "name",
        F.concat(
            F.concat_ws(" · ", F.concat_ws(", ", "area", "location"), "budget", "atmosphere"),
            F.lit(" atmosphere"),
        ).alias("caption"),
        "overall_rating",
        "ai_recommendation_score",
        "noise_level",
        "num_reviews",
        "ai_summary",
    )
    return VenueReport(
        header=header,
        scores=score_profile(chosen, vocab.DETAIL_SCORE_LABELS),
        aspects=aspect_rows(analysis.join(ids, "cafe_id", "left_semi")),
        reviews=review_listing(reviews.join(ids, "cafe_id", "left_semi")),
    )
