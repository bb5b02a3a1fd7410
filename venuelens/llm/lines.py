"""Line dedup: lines that many documents share stay in one document only.

Every text is split at line feeds.  A line's key is the line without white space at both ends
and with A-Z in lower case.  Long keys are hashed (128 bits), and distinct documents are
counted per hash.  Lines over the threshold go from all documents but the one with the
largest doc_id; texts are put together again by position.

Only (document, position, hash) is shuffled to count; texts meet their dropped positions
in one join by document.  The count is taken in two steps, so a line that a third of all
documents hold is counted in the tasks that read it, and the join against the shared hashes is one
that adaptive execution splits.  A text of any number of lines is cut in one pass over them.

Edge cases: a null or empty text is one empty line and stays as it is (null becomes empty);
rows with the same doc_id count as one document, each keeps its own lines; a row without doc_id
counts as one document smaller than all others; a text that loses all lines is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import free_name
from venuelens.session import written

MIN_LENGTH = 40
MIN_DOCUMENTS = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_WHITE))
    # For ASCII text the built-in lower() is the same and faster.
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, mark, drop): sorted positions of the lines that a row loses; rows that lose none are absent.

    ``mark`` is a hash of the text and tells rows with the same doc_id apart.
    """
    long_lines = (
        docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_length)
        .select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_length)
        .select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    long_lines = written(long_lines, "line-hashes")
    shared = (
        long_lines.groupBy("h1", "h2")
        .agg(
            F.count_distinct("doc_id").alias("n"),
            F.max(F.col("doc_id").isNull().cast("int")).alias("unnamed"),
            F.max("doc_id").alias("keeper"),
        )
        .where(F.col("n") + F.col("unnamed") >= min_documents)
        .select("h1", "h2", "keeper")
    )
    # Written, so that both sides of the join are plain shuffles, whose hot keys adaptive execution splits.
    shared = written(shared, "shared-lines")
    lost = long_lines.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` but for the sorted positions ``drop``, in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), F.slice(drop, F.lit(1), F.size(drop) - 1))
    gone = F.zip_with(drop, before, lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True))))
    marked = F.zip_with(lines, F.flatten(gone), lambda x, g: F.struct(x.alias("line"), F.coalesce(g, F.lit(False)).alias("gone")))
    return F.filter(marked, lambda m: ~m["gone"])["line"]


def dedup_lines(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, counts: bool = True
) -> DataFrame:
    """``docs`` with ``text`` cut down, and with ``counts`` also ``n_lines`` (before) and ``n_dropped``.

    With ``counts`` columns of these names in ``docs`` are replaced; all other columns stay.
    """
    lost = dropped_lines(docs, min_length, min_documents)
    mark, drop, key = (free_name(docs, x) for x in ("line_mark", "line_drop", "line_doc"))
    lost = lost.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("drop").alias(drop))
    same = docs["doc_id"].eqNullSafe(lost[key]) & (F.xxhash64(docs["text"]) == lost[mark])
    lines = _lines(F.col("text"))
    text = F.array_join(_without(lines, F.col(drop)), "\n")
    full = docs.join(lost, same, "left")
    if counts:
        full = full.withColumn("n_lines", F.size(lines).cast("bigint"))
        full = full.withColumn("n_dropped", F.coalesce(F.size(drop), F.lit(0)).cast("bigint"))
    full = full.withColumn("text", F.when(F.col(drop).isNull(), F.coalesce("text", F.lit(""))).otherwise(text))
    return full.drop(key, mark, drop)
