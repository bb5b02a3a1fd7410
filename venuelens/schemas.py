"""Explicit schemas: no source is ever read with inference."""

from __future__ import annotations

from pyspark.sql import types as T

from venuelens.vocab import FLAG_COLS, PRIORITIES, SCORE_COLS

#: Venue files as delivered: the flags are still free text.
VENUES_RAW = T.StructType(
    [
        T.StructField("cafe_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("budget", T.StringType()),
        T.StructField("atmosphere", T.StringType()),
        T.StructField("purpose_tags", T.StringType()),
        T.StructField("noise_level", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in FLAG_COLS],
        *[T.StructField(c, T.DoubleType()) for c in SCORE_COLS],
        T.StructField("overall_rating", T.DoubleType()),
    ]
)

#: ``review_id`` is the order key: "first" always means smallest ``review_id``.
REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("cafe_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_text", T.StringType()),
    ]
)

#: Keys that may be text as well as numbers.
KEYS = ("cafe_id", "review_id", "user_id")


def text_keys(schema: T.StructType) -> T.StructType:
    """The same schema with its keys as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in KEYS else f for f in schema.fields])


PREFS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("atmosphere", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("budget_text", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in PRIORITIES],
    ]
)

LEXICON = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("valence", T.DoubleType()),
    ]
)
