"""Column-level cleaning of venue and preference data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens import vocab


def parse_flag(col: Column) -> Column:
    """``true``/``false`` in any case become a boolean, everything else null."""
    lowered = F.lower(col.cast("string"))
    return F.when(lowered == "true", F.lit(True)).when(lowered == "false", F.lit(False))


def parse_flags(df: DataFrame, cols: list[str] = vocab.FLAG_COLS) -> DataFrame:
    return df.withColumns({c: parse_flag(F.col(c)) for c in cols})


def _lookup(col: Column, table: dict) -> Column:
    """``table[col]``, null when absent; a when-chain keeps it inside generated code."""
    (key, value), *rest = table.items()
    start = F.when(col == key, F.lit(value))
    return reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), rest, start)


def budget_label(symbol: Column) -> Column:
    return _lookup(symbol, vocab.BUDGET_SYMBOLS)


def with_budget_label(df: DataFrame) -> DataFrame:
    """Adds ``budget_label`` from the ``budget`` symbol unless the column is there already."""
    if "budget_label" in df.columns:
        return df
    return df.withColumn("budget_label", budget_label(F.col("budget")))


def normalize_tags(df: DataFrame, col: str = "purpose_tags") -> DataFrame:
    """One separator in tags that are text; lists stay as they are."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return df
    return df.withColumn(col, F.replace(F.col(col), F.lit("|"), F.lit(",")))


def tags_array(col: Column) -> Column:
    """Tags separated by ``,`` or ``|``, trimmed."""
    return F.transform(F.split(col, "[,|]"), lambda t: F.trim(t))


def tag_list(df: DataFrame, col: str = "purpose_tags") -> Column:
    """The tags of ``df`` as a list, whether they are stored as text or as a list."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.transform(F.col(col), lambda t: F.trim(t))
    return tags_array(F.col(col))


def parse_budget_amount(col: Column) -> Column:
    """The digits of a text as a number; 700 when there is none.

    A number beyond BIGINT gives null; its bucket is the highest.
    """
    digits = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "[^0-9]", "")
    return F.when(digits == "", F.lit(vocab.DEFAULT_BUDGET_AMOUNT).cast("bigint")).otherwise(
        digits.try_cast("bigint")
    )


def budget_bucket(amount: Column) -> Column:
    """The label of an amount; null is an amount beyond BIGINT."""
    low, mid, high = vocab.BUDGET_LABELS
    return (
        F.when(amount <= vocab.LOW_BUDGET_LIMIT, low)
        .when(amount <= vocab.MID_BUDGET_LIMIT, mid)
        .otherwise(high)
    )


def budget_ordinal(label: Column) -> Column:
    """1, 2 or 3; an unknown or missing label counts as 2."""
    return F.coalesce(_lookup(label, vocab.BUDGET_MAP), F.lit(vocab.DEFAULT_BUDGET_ORDINAL))


def budget_fraction(label: Column) -> Column:
    return budget_ordinal(label).cast("double") / F.lit(3.0)


def whole_stars(rating: Column) -> Column:
    """A rating cut to whole stars (toward zero)."""
    return rating.cast("int")
