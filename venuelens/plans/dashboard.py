"""Key figures and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.functions.rounding import exact_round
from venuelens.operators.ranking import leaderboard

# --- fixed values: name -> (column, size, budget symbol or None) ---------------
BOARDS = {
    "trending": ("ai_recommendation_score", 8, None),
    "instagram": ("instagram_score", 8, None),
    "study": ("study_score", 4, None),
    "date": ("date_score", 4, None),
    "coffee": ("coffee_score", 4, None),
    "budget": ("ai_recommendation_score", 4, "₹"),
}
# --- end of fixed values -------------------------------------------------------


def dashboard_kpis(enriched: DataFrame) -> DataFrame:
    """One row: venues, reviews, mean composite, mean rating, and both means as shown.

    The means are taken over exact decimal sums.
    """

    def mean(col):
        exact = F.col(col).cast("decimal(20,8)")
        return F.sum(exact).cast("double") / F.count(exact)

    figures = enriched.agg(
        F.count("*").alias("total_venues"),
        F.coalesce(F.sum("num_reviews"), F.lit(0).cast("bigint")).alias("total_reviews"),
        mean("ai_recommendation_score").alias("avg_ai_score"),
        mean("overall_rating").alias("avg_overall_rating"),
    )
    return figures.withColumns(
        {
            "avg_ai_score_shown": exact_round(F.col("avg_ai_score"), 1),
            "avg_overall_rating_shown": exact_round(F.col("avg_overall_rating"), 1),
        }
    )


def board(enriched: DataFrame, name: str) -> DataFrame:
    """One of the six boards of the dashboard."""
    by, k, symbol = BOARDS[name]
    where = None if symbol is None else F.col("budget") == symbol
    return leaderboard(enriched, by, k, where)
