"""Reading and writing the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens import schemas
from venuelens.functions.clean import normalize_tags, parse_flags, with_budget_label
from venuelens.session import written
from venuelens.sources.quoted_csv import POSITION, read_quoted_csv


def _read(spark: SparkSession, path, fmt: str, schema: T.StructType) -> DataFrame:
    if fmt == "json":
        # Read as text, so that a value that does not fit is noticed.
        stored = spark.read.schema(_as_text(schema)).json(path)
    elif fmt == "csv":
        # Columns are found by name, in any order, and cast to the declared types.
        return typed(read_quoted_csv(spark, path), schema, POSITION)
    else:
        stored = spark.read.format(fmt).load(path)
    return typed(stored, schema)


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def typed(stored: DataFrame, schema: T.StructType, *carried: str) -> DataFrame:
    """The columns of ``schema`` that ``stored`` has, in the declared types, and those ``carried``; nothing is lost silently.

    A value that does not fit its type fails the job and is named in the message; blanks and
    ``nan`` are missing numbers.  Keys that are stored as text in a typed file stay text; for
    keys that are text in a CSV or JSON file give ``schemas.text_keys(schema)``.
    """
    all_text = all(isinstance(f.dataType, T.StringType) for f in stored.schema.fields if f.name not in carried)

    def cast(f: T.StructField):
        raw, here = F.col(f.name), stored.schema[f.name].dataType
        if here == f.dataType or isinstance(here, T.ArrayType):
            return raw
        if f.name in schemas.KEYS and isinstance(here, T.StringType) and not all_text:
            return raw
        if isinstance(f.dataType, T.StringType):
            return raw.cast("string").alias(f.name)
        value = raw.try_cast(f.dataType)
        missing = raw.isNull() | F.lower(F.trim(raw.cast("string"))).isin("", "nan", "null", "none")
        told = F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), raw.cast("string"))
        return F.when(missing, F.lit(None)).otherwise(F.coalesce(value, F.raise_error(told).cast(f.dataType))).alias(f.name)

    return stored.select([cast(f) for f in schema.fields if f.name in stored.columns] + list(carried))


def read_venues(
    spark: SparkSession, path, fmt: str = "csv", schema: T.StructType = schemas.VENUES_RAW
) -> DataFrame:
    """Raw venues.  The flags are text; ``clean_venues`` types them."""
    return _require(_read(spark, path, fmt, schema), schema)


def read_reviews(
    spark: SparkSession, path, fmt: str = "csv", schema: T.StructType = schemas.REVIEWS
) -> DataFrame:
    """Reviews.

    A CSV file without ``review_id`` gets numbers in file order, whatever tasks read it; in
    other formats the numbers are written once with the reviews, so that every reader sees
    the same ones.
    """
    df = _read(spark, path, fmt, schema)
    if "review_id" not in df.columns and POSITION in df.columns:
        df = df.withColumnRenamed(POSITION, "review_id")
    if "review_id" not in df.columns:
        df = written(df.select(F.monotonically_increasing_id().alias("review_id"), "*"), "reviews")
    return _require(df, schema)


def read_prefs(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    return _require(_read(spark, path, fmt, schemas.PREFS), schemas.PREFS)


def _require(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df.select(*[f.name for f in schema.fields])


def clean_venues(raw: DataFrame) -> DataFrame:
    """Typed flags, budget label, one tag separator."""
    return normalize_tags(with_budget_label(parse_flags(raw)))


def load(
    spark: SparkSession, venues_path, reviews_path, fmt: str = "csv", text_keys: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Cleaned venues and reviews; with ``text_keys`` the keys in a text file are text."""
    venues, reviews = schemas.VENUES_RAW, schemas.REVIEWS
    if text_keys:
        venues, reviews = schemas.text_keys(venues), schemas.text_keys(reviews)
    return clean_venues(read_venues(spark, venues_path, fmt, venues)), read_reviews(
        spark, reviews_path, fmt, reviews
    )


def to_parquet(df: DataFrame, path: str) -> None:
    """The one-time conversion of a delivered file; files of about equal size."""
    df.hint("rebalance").write.mode("error").parquet(path)


def analysis_to_json(analysis: DataFrame) -> DataFrame:
    """One JSON text per record; missing values are written as ``null``."""
    record = F.struct(*analysis.columns)
    return analysis.select("cafe_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def write_analysis_json(analysis: DataFrame, path: str) -> None:
    analysis.write.option("ignoreNullFields", False).mode("error").json(path)
