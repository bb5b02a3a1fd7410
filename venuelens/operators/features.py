"""Content features: venues and preferences as vectors of one 18-place layout.

Six atmospheres (one-hot), five purposes (multi-hot), six scores in 0-1, budget tier / 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.functions.clean import (
    budget_bucket,
    budget_fraction,
    parse_budget_amount,
    tag_list,
    with_budget_label,
)
from venuelens.functions.scores import unit_score


def _one_hot(col: Column, values: list[str]) -> list[Column]:
    return [F.when(col == v, F.lit(1.0)).otherwise(F.lit(0.0)) for v in values]


def _multi_hot(tags: Column, values: list[str]) -> list[Column]:
    return [
        F.when(F.coalesce(F.array_contains(tags, v), F.lit(False)), F.lit(1.0)).otherwise(
            F.lit(0.0)
        )
        for v in values
    ]


def encode_venues(venues: DataFrame) -> DataFrame:
    """Adds ``features``.  Unknown atmospheres and purposes give zeros, an unknown or
    missing budget counts as the middle tier."""
    df = with_budget_label(venues)
    parts = (
        _one_hot(F.col("atmosphere"), vocab.ATMOSPHERES)
        + _multi_hot(tag_list(df), vocab.PURPOSES)
        + [unit_score(F.col(c)) for c in vocab.SCORE_COLS]
        + [budget_fraction(F.col("budget_label"))]
    )
    return df.withColumn("features", F.array(*parts))


def complete_prefs(prefs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Preferences with one column per setting and the defaults filled in.

    A budget label comes from ``budget`` if there, else from the amount written in
    ``budget_text``, else it is the middle one.  Priorities are flat columns or fields of
    a ``priorities`` struct.  ``keep`` names further columns to carry along.
    """
    cols = set(prefs.columns)
    if "budget" in cols:
        label = F.coalesce("budget", F.lit(vocab.BUDGET_LABELS[1]))
    elif "budget_text" in cols:
        label = budget_bucket(parse_budget_amount(F.col("budget_text")))
    else:
        label = F.lit(vocab.BUDGET_LABELS[1])

    nested: set[str] = set()
    if "priorities" in cols:
        nested = set(prefs.schema["priorities"].dataType.fieldNames())

    def priority(name: str, default: float) -> Column:
        if name in cols:
            return F.coalesce(F.col(name).cast("double"), F.lit(default))
        if name in nested:
            return F.coalesce(F.col(f"priorities.{name}").cast("double"), F.lit(default))
        return F.lit(default)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in cols else F.lit("")

    return prefs.select(
        "user_id",
        text("atmosphere").alias("atmosphere"),
        text("purpose").alias("purpose"),
        label.alias("budget"),
        *[priority(n, d).alias(n) for n, d in vocab.PRIORITY_DEFAULTS.items()],
        *keep,
    )


def encode_prefs(prefs: DataFrame) -> DataFrame:
    """Adds ``features`` in the venue layout; the purpose is a single value."""
    df = complete_prefs(prefs)
    parts = (
        _one_hot(F.col("atmosphere"), vocab.ATMOSPHERES)
        + _one_hot(F.col("purpose"), vocab.PURPOSES)
        + [F.col(p) for p in vocab.PRIORITIES]
        + [budget_fraction(F.col("budget"))]
    )
    return df.withColumn("features", F.array(*parts))
