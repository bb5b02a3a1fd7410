"""Per-venue review statistics and the review listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.functions.clean import whole_stars
from venuelens.functions.rounding import scaled_round
from venuelens.functions.text import has_text


def review_stats(reviews: DataFrame) -> DataFrame:
    """Count, mean rating and "has any text" per venue that has reviews.

    Null ratings are skipped by the mean.  The mean is taken over an exact decimal sum,
    so it does not depend on how the rows are partitioned.
    """
    rating = F.col("rating").cast("decimal(18,8)")
    return (
        reviews.groupBy("cafe_id")
        .agg(
            F.count("*").alias("num_reviews"),
            (F.sum(rating).cast("double") / F.count(rating)).alias("mean_rating"),
            F.max(has_text(F.col("review_text"))).alias("has_text"),
        )
        .select(
            "cafe_id",
            "num_reviews",
            scaled_round(F.col("mean_rating"), 2).alias("avg_review_rating"),
            "has_text",
        )
    )


def with_review_stats(venues: DataFrame, stats: DataFrame) -> DataFrame:
    """Every venue with its statistics: 0 reviews and no rating where there are none."""
    return venues.join(stats, "cafe_id", "left").withColumns(
        {
            "num_reviews": F.coalesce("num_reviews", F.lit(0).cast("bigint")),
            "has_text": F.coalesce("has_text", F.lit(False)),
        }
    )


def review_listing(reviews: DataFrame) -> DataFrame:
    """Reviews as they are listed: whole stars and the text."""
    return reviews.select(
        "cafe_id", "review_id", whole_stars(F.col("rating")).alias("stars"), "review_text"
    )
