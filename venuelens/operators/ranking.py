"""Leaderboards: the k best venues by one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaderboard(
    venues: DataFrame, by: str, k: int, where: Column | None = None, key: str = "cafe_id"
) -> DataFrame:
    """The ``k`` largest by ``by``; ties go to the smaller ``key``, nulls last.

    Sort plus limit is planned as one top-k per task and a merge, never a full sort.
    """
    pool = venues if where is None else venues.filter(where)
    return pool.orderBy(F.col(by).desc_nulls_last(), F.col(key).asc()).limit(k)
