"""Venue cards: the strings and defaults shown for a venue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens import vocab


def _score_text(col: str) -> Column:
    return F.concat(F.col(col).cast("string"), F.lit("/10"))


def venue_card(enriched: DataFrame) -> DataFrame:
    """One row of display values per venue (or per match, if ``match_score`` is there)."""
    cols = set(enriched.columns)
    place = F.concat_ws(", ", "area", "location")
    listed = isinstance(enriched.schema["purpose_tags"].dataType, T.ArrayType)
    tags = F.array_join("purpose_tags", ", ") if listed else F.replace("purpose_tags", F.lit(","), F.lit(", "))
    shown = {
        "caption": F.concat(
            F.concat_ws(" · ", place, "budget", "atmosphere"),
            F.lit(" atmosphere · Noise: "),
            F.coalesce("noise_level", F.lit("")),
        ),
        "tags": F.concat_ws(" · ", tags, "budget_label"),
        "ai_score": _score_text("ai_recommendation_score"),
        **{
            "show_" + c.removesuffix("_score"): F.concat(
                F.col(c).cast("double").cast("string"), F.lit("/10")
            )
            for c in vocab.SCORE_COLS
        },
        "summary": F.coalesce("ai_summary", F.lit(vocab.NO_SUMMARY)),
        "reviews": F.coalesce("num_reviews", F.lit(0).cast("bigint")),
        "rating": F.coalesce(F.col("avg_review_rating").cast("string"), F.lit(vocab.NO_RATING)),
    }
    keys = [c for c in ("user_id", "rank") if c in cols]
    extra = {}
    if "match_score" in cols:
        extra["match"] = F.concat(F.col("match_score").cast("string"), F.lit("%"))
    return enriched.select(
        *keys, "cafe_id", "name", *[v.alias(n) for n, v in (shown | extra).items()]
    )
