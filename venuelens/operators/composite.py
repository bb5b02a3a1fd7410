"""The composite score: a weighted sum of the stated scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.functions.rounding import exact_round


def composite(weights: dict[str, float] = vocab.COMPOSITE_WEIGHTS) -> Column:
    """Weighted sum in the order of ``weights``, two decimals; null if a score is null."""
    terms = [F.col(c).cast("double") * F.lit(w) for c, w in weights.items()]
    return exact_round(reduce(add, terms), 2)


def composite_score(
    venues: DataFrame,
    weights: dict[str, float] = vocab.COMPOSITE_WEIGHTS,
    name: str = "ai_recommendation_score",
) -> DataFrame:
    return venues.withColumn(name, composite(weights))
