"""How document filters interact: every order of the filters, step by step.

Each document gets a mask with a bit for each filter that it fails.  Documents are counted by
(part, mask); these cells are all that the orders need.  A recursive CTE starts from the empty
prefix of each part and extends every prefix by each filter that it does not use yet.  The
recursion carries the applied bits, joins the part's mask cells, and each level gives the
counts of the step that it adds.  Prefixes are shared: the step counts of a prefix serve all orders
that begin with it.

The texts are read once.  Copies are found by the SHA-256 digest of the text: only digests that occur
more than once are joined back, and they are written first, so that adaptive execution can split the
digest of a text that a third of all documents share.  Rows of the recursion: one per part and
prefix, 326 for five filters; it is written in the shared folder, not kept in memory.

Edge cases: a null text counts as empty and an empty text has no words (it fails the word count, not
the share of distinct words); a null part value counts as the empty string; rows without doc_id are
no one's smaller document and never count as copies; repeated rows of one doc_id count each, and are no
copies of each other; a document with several labels counts as good or toxic if one of them says so;
other columns of ``docs`` and ``labels`` are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.session import written

#: Orders are listed in full, so their number bounds the filters.
MAX_FILTERS = 8
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def document_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that one document decides, by letter; ``text`` must not be null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * distinct < 50 * n_words,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, filters: Mapping[str, Column], copies: str, part: str) -> DataFrame:
    """(doc_id, part, mask) for each row of ``docs``; bit ``k`` of the mask: the ``k``-th letter in order fails."""
    letters = sorted([*filters, copies])
    bits = {x: F.lit(1 << k) for k, x in enumerate(letters)}
    text = F.coalesce("text", F.lit(""))
    own = sum((F.when(filters[x], bits[x]).otherwise(0) for x in sorted(filters)), F.lit(0))
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        own.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = written(rows, "audit-rows")
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("digest", "least"), "audit-copies")
    copy = F.when(F.col("doc_id") > F.col("least"), bits[copies]).otherwise(0)
    return rows.join(shared, "digest", "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: ``cells``, the documents (n, good, toxic) by mask."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = masks.join(written(marks, "audit-labels"), "doc_id", "left")
    counted = marked.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    return counted.groupBy("part").agg(cells)


def _summed(field: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (a, x) -> a + x.{field})"


def prefix_steps(cells: DataFrame, letters: list[str]) -> DataFrame:
    """(part, prefix, step, letter, counts): the last step of every non-empty prefix of the letters, by a recursive CTE."""
    spark = cells.sparkSession
    view = f"mask_cells_{uuid.uuid4().hex}"
    each = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    here = "(x.mask & f.bit) <> 0 and (x.mask & p.applied) = 0"
    query = f"""
      with recursive prefixes as (
        select part, '' as prefix, '' as letter, 0 as applied, 0 as step, 0L as kept, 0L as removed, 0L as redundant,
          0L as unique_fails, 0L as good_lost, 0L as toxic_lost
        from {view}
        union all
        select c.part, concat(p.prefix, f.letter), f.letter, p.applied | f.bit, p.step + 1,
          {_summed("n", "(x.mask & (p.applied | f.bit)) = 0")}, {_summed("n", here)},
          {_summed("n", "(x.mask & f.bit) <> 0 and (x.mask & p.applied) <> 0")}, {_summed("n", "x.mask = f.bit")},
          {_summed("good", here)}, {_summed("toxic", here)}
        from prefixes p join {view} c on p.part = c.part
        lateral view explode(filter(array({each}), y -> (y.bit & p.applied) = 0)) t as f
      )
      select * from prefixes where step > 0"""
    limit = spark.conf.get(_ROW_LIMIT, None)
    cells.createOrReplaceTempView(view)
    try:
        spark.conf.set(_ROW_LIMIT, "-1")  # rows follow the number of parts; the levels are bounded by the letters
        return written(spark.sql(query).drop("applied"), "audit-prefixes")
    finally:
        spark.catalog.dropTempView(view)
        spark.conf.set(_ROW_LIMIT, limit) if limit is not None else spark.conf.unset(_ROW_LIMIT)


def filter_audit(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str = "E", part: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step.

    ``filters``: failure conditions on columns of ``docs`` by letter (default: ``document_filters``);
    ``copies``: the letter of the filter that drops texts which a smaller doc_id has.  Columns: part,
    filter_order, step; kept, removed, redundant (failing, removed earlier), unique_fails (failing this filter
    only), good_lost, toxic_lost (removed here); shapley (removed by this filter, summed over all orders).
    """
    if filters is None:
        filters = document_filters(F.coalesce("text", F.lit("")))
    letters = sorted([*filters, copies])
    if len(set(letters)) != len(letters) or any(len(x) != 1 or not x.isalnum() for x in letters):
        raise ValueError("each filter needs a letter of its own")
    if len(letters) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    cells = written(mask_cells(failure_masks(docs, filters, copies, part), labels), "audit-cells")
    steps = prefix_steps(cells, letters)
    orders = steps.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    each = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    each = each.withColumn("prefix", F.substring("filter_order", 1, F.col("step")))
    full = each.join(steps.drop("step"), ["part", "prefix"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return full.select("part", "filter_order", "step", *counts, shapley.alias("shapley"))
