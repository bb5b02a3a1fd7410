"""Quoted CSV read by many tasks: records whose quoted fields hold line breaks, split anywhere.

Spark reads such a file with one task, as a line break may or may not end a record.  Here the lines are
read by as many tasks as the file has splits, in two passes:

1. quotes and lines are counted per split; their running sums per file tell whether a split begins
   inside a quoted field, and at which line;
2. each task puts its lines together to records, starting from that state.  The piece before a
   split's first record end and the one after its last are joined with those of the next splits.

Only counts per split and these pieces are shuffled.  A record is numbered by its file and its first line,
so the numbers follow the order in the files however they are split or packed.  The records are written
once, since later readers may split the files in another way.

Quotes inside quoted fields are doubled, text is UTF-8.  A file whose last quote never closes ends with
that record.  Empty lines between records are skipped.  All files need the same header.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuelens.session import broadcast_if_small, written

# Functions for tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The column with the number of a record.
POSITION = "_position"
#: Splits whose states are broadcast, at most; with more of them the lines are shuffled to their split's state.
MAX_SPLITS = 100_000
#: Bits of a record's number for its line; the file's place stands above.
LINE_BITS = 40
_OPTIONS = {"multiLine": "true", "escape": '"'}
_PIECES = "file string, block bigint, line bigint, kind int, text string"
_HEAD, _TAIL, _RECORD = 0, 1, 2
_BATCH = 10_000


def _records(batches):
    """Records of the lines of each split; kind 0: before the first record end of a split that begins in quotes,
    1: after its last record end, 2: whole."""
    place, out = None, []
    held: list[str] = []
    line = first = 0
    inside = begun = False

    def batch() -> pa.RecordBatch:
        names = ["file", "block", "line", "kind", "text"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def close(kind: int) -> None:
        if held:
            out.append((*place, first, kind, "\n".join(held)))
            held.clear()

    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in ("file", "block", "value", "odd", "start"))
        for file, block, value, odd, start in zip(*columns, strict=True):
            if (file, block) != place:
                close(_TAIL if begun else _HEAD)
                place, line, inside, begun = (file, block), start, odd, not odd
            if not held:
                first = line
            held.append(value)
            line += 1
            inside ^= value.count('"') % 2 == 1
            if not inside:
                close(_RECORD if begun else _HEAD)
                begun = True
            if len(out) >= _BATCH:
                yield batch()
    close(_TAIL if begun else _HEAD)
    if out:
        yield batch()


def _lines(spark: SparkSession, path) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(file, line, text) of every record, line breaks inside quotes kept; ``line`` counts the file's lines from 0."""
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = written(lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"), F.count("*").alias("lines")), "csv-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select(
        "file", "block",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"),
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"),
    )
    if states.limit(MAX_SPLITS + 1).count() <= MAX_SPLITS:
        placed = lines.join(F.broadcast(states), ["file", "block"], "left")
    else:
        kept = lines.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "block"], "left")
        placed = kept.sortWithinPartitions("file", "block", "at")
    known = F.coalesce("start", F.raise_error(F.lit("the files were split in another way meanwhile")).cast("bigint"))
    placed = placed.select("file", "block", "value", "odd", known.alias("start"))
    pieces = written(placed.mapInArrow(_records, _PIECES), "csv-pieces")
    # A tail opens a record; the heads of the splits after it, one of each, go on until one closes it.
    order = Window.partitionBy("file").orderBy("block", "kind")
    broken = pieces.where(F.col("kind") != _RECORD).withColumn("chain", F.count_if(F.col("kind") == _TAIL).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "line", "text")))
    joined = broken.groupBy("file", "chain").agg(parts.alias("parts")).select(
        "file", F.get("parts", F.lit(0))["line"].alias("line"), F.array_join(F.col("parts")["text"], "\n").alias("text")
    )
    return pieces.where(F.col("kind") == _RECORD).select("file", "line", "text").union(joined)


def read_quoted_csv(spark: SparkSession, path) -> DataFrame:
    """The columns that the header names, as text, and ``_position``, the number of the record in file order."""
    records = csv_records(spark, path)
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r$", "")
    records = records.withColumn("text", text)
    headers = records.where("line = 0").select("text").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"{path}: files with different headers" if headers else f"{path}: no header")
    columns = ", ".join(f"`{n.replace('`', '``')}` string" for n in _fields(spark, headers[0].text))
    files = records.where("line = 0").select("file").withColumn("place", F.row_number().over(Window.orderBy("file")) - 1)
    parsed = records.where((F.col("line") > 0) & (F.col("text") != "")).join(broadcast_if_small(files, MAX_SPLITS), "file")
    number = F.shiftleft(F.col("place").cast("bigint"), LINE_BITS) + F.col("line") - 1
    return parsed.select(number.alias(POSITION), F.from_csv("text", columns, _OPTIONS).alias("r")).select(POSITION, "r.*")


def _fields(spark: SparkSession, header: str) -> list[str]:
    """The names in a header record."""
    width = header.count(",") + 1
    columns = ", ".join(f"c{i} string" for i in range(width))
    row = spark.range(1).select(F.from_csv(F.lit(header), columns, _OPTIONS).alias("r")).select("r.*").first()
    return [x for x in row if x is not None]
