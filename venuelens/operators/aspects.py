"""Aspect sentiment: which aspects a sentence touches, and how venues fare on them."""

from __future__ import annotations

import sys
from functools import reduce
from operator import add, or_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.functions import text as X
from venuelens.functions.scores import score_to_ten
from venuelens.operators.sentiment import score_sentences
from venuelens.operators.terms import sentences
from venuelens.session import written

# Functions for tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BITS = 62
#: Rows of a keyword table in one automaton, about; a larger table gets several.
AUTOMATON_ROWS = 500_000
#: Lengths of parts that a keyword looks up, and the length from which it looks up none.
_PART_LENGTHS, _LONG_KEYWORD = 16, 200


def mentions_any(lowered: Column, keywords: list[str]) -> Column:
    """Any keyword anywhere in the text: a substring test, not a word test."""
    return reduce(or_, [F.contains(lowered, F.lit(k)) for k in keywords])


def _chunks(aspects: dict[str, list[str]]) -> dict[str, list[str]]:
    """Aspect names by the bit column that marks them, ``_BITS`` to a column."""
    names = list(aspects)
    return {f"touched{i}": names[i : i + _BITS] for i in range(0, len(names), _BITS)}


def _from_bits(chunks: dict[str, list[str]]) -> Column:
    marks = [
        F.when(F.col(c).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(n))
        for c, names in chunks.items()
        for i, n in enumerate(names)
    ]
    return F.array_compact(F.array(*marks))


def aspect_sentences(
    reviews: DataFrame, aspects: dict[str, list[str]] = vocab.ASPECT_KEYWORDS
) -> DataFrame:
    """Sentences that touch at least one aspect; the aspects are bits of ``touched...``."""
    lowered = F.col("cut.lowered")
    chunks = _chunks(aspects)
    bits = {
        c: reduce(
            add,
            [
                F.when(mentions_any(lowered, aspects[n]), F.lit(1 << i).cast("bigint")).otherwise(
                    F.lit(0).cast("bigint")
                )
                for i, n in enumerate(names)
            ],
        )
        for c, names in chunks.items()
    }
    # Lower case is worked out before the sentences become rows: the filter below would repeat it for every keyword.
    both = F.transform(
        X.sentence_array(F.col("review_text")), lambda s: F.struct(s.alias("sentence"), F.lower(s).alias("lowered"))
    )
    cut = reviews.select("cafe_id", "review_id", F.posexplode(both).alias("sent_pos", "cut"))
    return (
        cut.withColumns(bits)
        .filter(reduce(or_, [F.col(c) != 0 for c in chunks]))
        .select("cafe_id", "review_id", "sent_pos", F.col("cut.sentence").alias("sentence"), *chunks)
    )


def aspect_mentions(
    reviews: DataFrame, aspects: dict[str, list[str]] = vocab.ASPECT_KEYWORDS
) -> DataFrame:
    """One ``(cafe_id, review_id, sent_pos, aspect)`` row per mention."""
    return aspect_sentences(reviews, aspects).select(
        "cafe_id", "review_id", "sent_pos", F.explode(_from_bits(_chunks(aspects))).alias("aspect")
    )


def _without_covered(keyed: DataFrame) -> DataFrame:
    """``keyed`` without keywords that hold another keyword of the same aspect.

    Wherever such a keyword occurs the shorter one occurs too, so no mention is lost.  Each keyword
    looks up its own parts of the ``_PART_LENGTHS`` shortest lengths that keywords have; a very long one is
    kept without a look, which costs a pattern but changes no result.
    """
    found = keyed.select(F.length("keyword").alias("n")).distinct().orderBy("n").limit(_PART_LENGTHS).collect()
    lengths = [r.n for r in found]
    long = F.col("keyword")
    starts = F.sequence(F.lit(1), F.length(long))
    parts = F.flatten(
        F.transform(
            F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.length(long)),
            lambda n: F.transform(F.slice(starts, 1, F.length(long) - n + 1), lambda i: F.substring(long, i, n)),
        )
    )
    looked = keyed.where((F.length(long) > lengths[0]) & (F.length(long) <= _LONG_KEYWORD)).select(
        "aspect", F.col("keyword").alias("whole"), F.explode(F.array_distinct(parts)).alias("keyword")
    )
    covered = looked.join(keyed, ["aspect", "keyword"], "left_semi").select("aspect", F.col("whole").alias("keyword")).distinct()
    return keyed.join(covered, ["aspect", "keyword"], "left_anti")


def _automaton_mentions(words, place: list[str]):
    """Every sentence in one pass through the automaton of ``words``, each aspect once per sentence."""

    def run(batches):
        import ahocorasick

        kinds: dict[tuple, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for keyword, aspects in words.value:
            automaton.add_word(keyword, kinds.setdefault(aspects, len(kinds)))
        automaton.make_automaton()
        of_kind = list(kinds)
        for batch in batches:
            rows, names = [], []
            for i, text in enumerate(batch.column("lowered").to_pylist()):
                held = {kind for _, kind in automaton.iter(text)}
                if held:
                    touched = set().union(*[of_kind[k] for k in held])
                    rows += [i] * len(touched)
                    names += touched
            if rows:
                kept = [batch.column(c).take(pa.array(rows)) for c in place]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string())], names=[*place, "aspect"])

    return run


def aspect_mentions_from_table(
    reviews: DataFrame, keywords: DataFrame, automaton_rows: int | None = None
) -> DataFrame:
    """The same for a keyword table ``(aspect, keyword)`` that is too large for literals.

    The keywords are the patterns of an Aho-Corasick automaton, which finds all of them as substrings in
    one pass over a sentence, whatever their number, lengths and overlaps.  Keywords that hold another
    of the same aspect say nothing new and are dropped first, so longer words of a growing vocabulary
    add no patterns.  The rest is written once and dealt by hash into automata of about
    ``automaton_rows`` (``AUTOMATON_ROWS``) rows; each is broadcast and meets all sentences.  With one
    automaton nothing is shuffled.  Null and empty keywords and null aspects are left out.
    """
    spark = reviews.sparkSession
    place = ["cafe_id", "review_id", "sent_pos"]
    keyed = keywords.select(F.col("aspect").cast("string").alias("aspect"), F.lower("keyword").alias("keyword"))
    keyed = keyed.where((F.length("keyword") > 0) & F.col("aspect").isNotNull()).distinct()
    keyed = written(keyed, "keywords")
    keyed = written(_without_covered(keyed), "keywords-apart") if not keyed.isEmpty() else keyed
    parts = max(1, -(-keyed.count() // (automaton_rows or AUTOMATON_ROWS)))
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("keyword", "aspect"), F.lit(parts)))
    lowered = sentences(reviews).select(*place, F.lower("sentence").alias("lowered"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lowered.schema if f.name in place)
    found = []
    for part in range(parts):
        words = dealt.where(F.col("part") == part).groupBy("keyword").agg(F.array_sort(F.collect_list("aspect")).alias("aspects"))
        listed = [(r.keyword, tuple(r.aspects)) for r in words.toLocalIterator()]
        if listed:
            run = _automaton_mentions(spark.sparkContext.broadcast(listed), place)
            found.append(lowered.mapInArrow(run, f"{schema}, `aspect` string"))
    if not found:
        return lowered.select(*place, F.lit("").alias("aspect")).limit(0)
    return found[0] if len(found) == 1 else reduce(DataFrame.union, found).distinct()


def aspect_by_review(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    aspects: dict[str, list[str]] = vocab.ASPECT_KEYWORDS,
    **scoring,
) -> DataFrame:
    """Mean sentence sentiment per (review, aspect): only aspects the review touches.

    Each touched sentence is scored once, in the task that cut it: its tokens are combined
    there, and only keys, bits and sums are shuffled, never a text.  The sum over
    sentences is exact (decimal), so it does not depend on the partitioning.
    """
    chunks = _chunks(aspects)
    touched = aspect_sentences(reviews, aspects)
    scored = score_sentences(touched, lexicon, carry=["cafe_id", *chunks], **scoring)
    return (
        scored.select(
            "cafe_id", "review_id", F.explode(_from_bits(chunks)).alias("aspect"), "compound"
        )
        .groupBy("cafe_id", "review_id", "aspect")
        .agg(
            F.count("*").alias("n_sentences"),
            (F.sum(F.col("compound").cast("decimal(12,4)")).cast("double") / F.count("*")).alias("compound"),
        )
    )


def aspect_by_venue(per_review: DataFrame) -> DataFrame:
    """Mean of the per-review means, and the same on the 0-10 scale.

    The sum is exact (decimal), so the result does not depend on the partitioning.
    """
    exact = F.col("compound").cast("decimal(20,16)")
    return (
        per_review.groupBy("cafe_id", "aspect")
        .agg(
            F.count("*").alias("n_reviews"),
            (F.sum(exact).cast("double") / F.count("*")).alias("compound"),
        )
        .withColumn("score", score_to_ten(F.col("compound")))
    )


def aspect_map(per_venue: DataFrame) -> DataFrame:
    """One ``aspect -> score`` map per venue."""
    entries = F.array_sort(F.collect_list(F.struct("aspect", "score")))
    return per_venue.groupBy("cafe_id").agg(
        F.map_from_entries(entries).alias("aspect_sentiment_10")
    )
