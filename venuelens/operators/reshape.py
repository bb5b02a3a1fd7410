"""Wide to long: score profiles and aspect rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens import vocab


def score_profile(
    venues: DataFrame, labels: dict[str, str] = vocab.SHORT_SCORE_LABELS
) -> DataFrame:
    """One ``(cafe_id, label, score)`` row per venue and score column."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("score"))
            for c, label in labels.items()
        ]
    )
    return venues.select("cafe_id", F.inline(pairs))


def aspect_rows(analysis: DataFrame, col: str = "aspect_sentiment_10") -> DataFrame:
    """One ``(cafe_id, aspect, score)`` row per entry of the aspect map."""
    return analysis.select("cafe_id", F.explode(col).alias("aspect", "score"))
