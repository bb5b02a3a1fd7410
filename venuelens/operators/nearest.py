"""Exact k nearest stored vectors by cosine similarity, pruned by angle.

Vectors are grouped into blocks by a column of the table (a cluster or class label),
hashed into at most ``MAX_BLOCKS`` blocks.  A block is summarised by its mean direction
and the largest angle to it.  By the triangle inequality of angles, no member can be
closer to a query than the query's angle to the mean minus that radius, so blocks beyond
a proven limit are skipped.  The pruning never drops a neighbour; vectors without any
grouping give loose bounds, and then most pairs are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuelens.functions.vectors import dot, doubles, unit

MAX_BLOCKS = 1024
#: Angles from ``acos`` carry errors up to about 1e-8 near 0.
MARGIN = 1e-6


def _mean_directions(rows: DataFrame, by: str, vec: str, out: str) -> DataFrame:
    """The unit vector of the mean of ``vec`` per group; sums are combined per task."""
    return (
        rows.select(by, F.posexplode(vec).alias("place", "part"))
        .groupBy(by, "place")
        .agg(F.avg("part").alias("part"))
        .groupBy(by)
        .agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
        .select(by, unit(F.transform("parts", lambda p: p["part"])).alias(out))
        .filter(F.col(out).isNotNull())
    )


def mean_directions(rows: DataFrame, by: str, vec: str, out: str = "direction") -> DataFrame:
    """One unit vector per group: the direction of the mean of its vectors."""
    return _mean_directions(rows.select(by, doubles(F.col(vec)).alias("v")), by, "v", out)


def nearest(
    stored: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query",
    block_col: str = "label",
) -> DataFrame:
    """``(query_id, rank, vec_id, similarity)``: the ``k`` best stored vectors per query.

    Ties go to the smaller id; vectors without a direction are not ranked.
    """
    base = stored.select(
        F.col(id_col).alias("vec_id"),
        F.pmod(F.xxhash64(F.col(block_col)), F.lit(MAX_BLOCKS)).alias("block"),
        unit(doubles(F.col(vec_col))).alias("v"),
    ).filter(F.col("v").isNotNull())
    asked = queries.select(
        F.col(query_id).alias("query_id"), unit(doubles(F.col(query_vec))).alias("q")
    ).filter(F.col("q").isNotNull())

    centres = F.broadcast(_mean_directions(base, "block", "v", "centre"))
    # a block whose mean has no direction gets no centre: radius pi, never skipped
    members = base.join(centres, "block", "left")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("centre")))))
    blocks = F.broadcast(
        members.groupBy("block").agg(
            F.count("*").alias("n"), F.coalesce(F.max(angle), F.lit(3.2)).alias("radius")
        ).join(centres, "block", "left")
    )
    to_centre = F.coalesce(
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("q"), F.col("centre"))))),
        F.lit(0.0),
    )
    # every query looks up the block summaries (at most MAX_BLOCKS), never every vector
    reach = (
        asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(MAX_BLOCKS - 1))))
        .withColumn("block", F.col("block").cast("bigint"))
        .join(blocks, "block")
        .select("query_id", "block", "n", to_centre.alias("angle"), "radius")
    )
    limit = reach.filter(F.col("n") >= k).groupBy("query_id").agg(
        F.min(F.col("angle") + F.col("radius")).alias("limit")
    )
    open_blocks = (
        reach.join(limit, "query_id", "left")
        .filter(
            F.col("limit").isNull()
            | (F.col("angle") - F.col("radius") <= F.col("limit") + F.lit(MARGIN))
        )
        .select("query_id", "block")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return (
        open_blocks.join(asked, "query_id")
        .join(base, "block")
        .select("query_id", "vec_id", dot(F.col("q"), F.col("v")).alias("similarity"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "similarity")
    )
