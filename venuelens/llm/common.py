"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside.

    Executors hold batches outside their heap, so rows of about a megabyte need small ones.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_rest(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts))


def bounded_labels(labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most about ``bound`` rows (doc_id, y), one per labelled document, picked by a hash of the key.

    Rows with a null key or label teach nothing.  Several labels of one document count as
    their majority, a tie as 1.  The share that is kept follows from the number of rows, so
    the result stays bounded while ``labels`` grows, and it is what may be broadcast.
    """
    one = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .where(keep)
    )
    share = min(1.0, bound / max(1, one.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("label sample")), F.lit(1 << 30))
    return one.where(place < int(share * (1 << 30)))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups, from batches sorted by ``keys``; only the open group is held back."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        same = (batch[keys] == last).all(axis=1).to_numpy()
        start = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if start:
            yield pd.concat([*rest, batch.iloc[:start]], ignore_index=True) if rest else batch.iloc[:start]
            rest = [batch.iloc[start:]]
        elif rest and (rest[-1][keys].iloc[-1] != last).any():
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pd.concat(rest, ignore_index=True)
