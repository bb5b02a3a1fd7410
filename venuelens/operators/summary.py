"""Extractive summaries: the most salient sentences of each venue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.functions import text as X
from venuelens.operators.terms import first_position, has_text_key, not_stopword, sentences, term_counts
from venuelens.session import broadcast_if_small, written

#: Frequent words of all venues together that are broadcast to bound the salience of sentences (some 30 MB).
MAX_FREQUENT = 200_000
#: Chosen sentences whose places are broadcast to look up their texts (some 50 MB); more are joined by shuffle.
MAX_CHOSEN = 500_000


def distinct_sentences(reviews: DataFrame, min_tokens: int = 4) -> DataFrame:
    """Sentences of at least ``min_tokens`` tokens, once per venue and lower-cased text.

    ``(review_id, sent_pos)`` is the place of the first occurrence.  Copies are combined
    inside each map task, so a sentence that makes up a third of all rows costs one row
    per task.
    """
    first_at, text_key = F.col("first_at"), has_text_key(reviews)
    return (
        sentences(reviews)
        .filter(X.has_tokens(F.col("sentence"), min_tokens))
        .groupBy("cafe_id", F.lower("sentence").alias("key"))
        .agg(first_position(reviews, "sent_pos").alias("first_at"))
        .select(
            "cafe_id",
            X.position_review(first_at, text_key).alias("review_id"),
            X.position_offset(first_at, text_key).alias("sent_pos"),
            "key",
        )
    )


def sentence_salience(
    distinct: DataFrame, counts: DataFrame, stopwords: Iterable[str] = tuple(vocab.STOPWORDS)
) -> DataFrame:
    """Sum of the venue-wide counts of a sentence's words, over its word count plus one.

    ``weight`` is an integer sum, so ranks do not depend on the order of addition.
    A sentence without a countable word joins under its own place (no word looks like
    a number) instead of a null key, which would put all such sentences of a venue in
    one task.  The other hot keys, frequent words of a large venue, meet exactly one
    row of ``counts``: adaptive execution can split them freely.
    """
    place = ["cafe_id", "review_id", "sent_pos"]
    found = X.word_array(F.col("key"))
    listed = distinct.select(*place, found.alias("found")).select(
        *place,
        F.size("found").alias("n_words"),
        F.explode_outer(F.filter("found", lambda w: not_stopword(w, stopwords))).alias("listed"),
    )
    own_place = F.concat_ws(" ", "review_id", "sent_pos")
    keyed = listed.select(*place, "n_words", F.coalesce("listed", own_place).alias("word"))
    return (
        keyed.join(counts.select("cafe_id", "word", "n"), ["cafe_id", "word"], "left")
        .groupBy(*place, "n_words")
        .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("weight"))
        .withColumn("ratio", F.col("weight") / (F.col("n_words") + F.lit(1)))
    )


def salience_bounds(
    distinct: DataFrame, frequent: DataFrame, stopwords: Iterable[str] = tuple(vocab.STOPWORDS)
) -> DataFrame:
    """``least`` and ``most``, between which the salience of each sentence lies.

    ``frequent`` (cafe_id, word, n, rest) are the most frequent words of each venue, and ``rest`` is a count
    that no other word of it exceeds; a venue without such words has a row with a null word.  The counts of the frequent words are exact, so only the others are
    bounded.  The words meet a broadcast table where the sentence is read, and are summed there.
    """
    place = ["cafe_id", "review_id", "sent_pos"]
    found = X.word_array(F.col("key"))
    words = distinct.select(*place, found.alias("found")).select(
        *place, F.size("found").alias("n_words"), F.posexplode_outer("found").alias("at", "listed")
    )
    # The first word stays, for sentences that have only stopwords.
    counted = not_stopword(F.col("listed"), stopwords)
    words = words.where((F.coalesce("at", F.lit(0)) == 0) | counted)
    words = words.select(*place, "n_words", F.when(counted, F.col("listed")).alias("word"))
    rests = frequent.groupBy("cafe_id").agg(F.max("rest").alias("rest"))
    unknown = F.col("word").isNotNull() & F.col("n").isNull()
    sums = (
        words.join(F.broadcast(frequent.select("cafe_id", "word", "n")), ["cafe_id", "word"], "left")
        .groupBy(*place, "n_words")
        .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("known"), F.count(F.when(unknown, 1)).alias("others"))
        .join(F.broadcast(rests), "cafe_id", "left")
    )
    below = F.col("n_words") + F.lit(1)
    highest = F.col("known") + F.col("others") * F.coalesce("rest", F.lit(0).cast("bigint"))
    return sums.select(*place, "n_words", (F.col("known") / below).alias("least"), (highest / below).alias("most"))


def _counts_of_counts(counts: DataFrame) -> DataFrame:
    """``(cafe_id, n, words)``: how many words of a venue occur ``n`` times."""
    return counts.groupBy("cafe_id", "n").agg(F.count("*").alias("words"))


def _frequent_words(counts: DataFrame, levels: DataFrame, n_words: int) -> DataFrame:
    """The most frequent words of each venue, at most ``n_words``, with the highest count of the others as ``rest``.

    Words of equal count are taken or left together, so the few counts of ``levels`` are ranked and not the words.
    """
    down = Window.partitionBy("cafe_id").orderBy(F.col("n").desc())
    too_many = F.sum("words").over(down) > n_words
    rests = levels.withColumn("left", F.when(too_many, F.col("n"))).groupBy("cafe_id").agg(F.coalesce(F.max("left"), F.lit(0)).alias("rest"))
    rests = written(rests, "rests")
    taken = counts.join(F.broadcast(rests), "cafe_id").where(F.col("n") > F.col("rest")).select("cafe_id", "word", "n", "rest")
    none = [F.lit(None).cast(counts.schema[c].dataType).alias(c) for c in ("word", "n")]
    return taken.union(rests.select("cafe_id", *none, "rest"))


def _may_win(distinct: DataFrame, bounds: DataFrame, max_sentences: int) -> DataFrame:
    """The rows of ``distinct`` whose salience may be among the ``max_sentences`` highest of their venue."""
    order = Window.partitionBy("cafe_id").orderBy(F.col("least").desc())
    limits = (
        bounds.select("cafe_id", "least")
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= max_sentences)
        .where(F.col("at") == max_sentences)
        .select(F.col("cafe_id").alias("limit_of"), F.col("least").alias("limit"))
    )
    open_rows = bounds.join(F.broadcast(limits), bounds["cafe_id"].eqNullSafe(F.col("limit_of")), "left").where(
        F.col("limit").isNull() | (F.col("most") >= F.col("limit"))
    )
    left = broadcast_if_small(
        open_rows.select(*[F.col(c).alias(f"open_{c}") for c in ("cafe_id", "review_id", "sent_pos")]).distinct(), MAX_CHOSEN
    )
    same = [distinct[c].eqNullSafe(F.col(f"open_{c}")) for c in ("cafe_id", "review_id", "sent_pos")]
    return distinct.join(left, same, "left_semi")


def top_sentences(salience: DataFrame, max_sentences: int = 3) -> DataFrame:
    order = Window.partitionBy("cafe_id").orderBy(
        F.col("ratio").desc(), "review_id", "sent_pos"
    )
    return salience.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max_sentences
    )


def summary_sentences(
    reviews: DataFrame,
    max_sentences: int = 3,
    stopwords: Iterable[str] = tuple(vocab.STOPWORDS),
    min_tokens: int = 4,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``(cafe_id, rank, review_id, sent_pos, n_words, weight, score, sentence)``.

    ``score`` is the salience with counts scaled by the venue's largest count.  The
    sentence text is looked up again for the few winners, instead of travelling with
    every word.

    Word counts (unless the caller gives ``counts``) and distinct sentences are written once.  Sentences that
    the counts of frequent words rule out meet no other counts: where the venues are at most
    ``MAX_FREQUENT``, only the rest is joined with all counts by shuffle.
    """
    if counts is None:
        counts = written(term_counts(reviews, stopwords).select("cafe_id", "word", "n"), "word-counts")
    distinct = distinct_sentences(reviews, min_tokens)
    levels = written(_counts_of_counts(counts), "counts-of-counts")
    venues = levels.select("cafe_id").distinct().limit(MAX_FREQUENT + 1).count()
    if 0 < venues <= MAX_FREQUENT:
        distinct = written(distinct, "distinct-sentences")
        frequent = written(_frequent_words(counts, levels, MAX_FREQUENT // venues), "frequent-words")
        bounds = written(salience_bounds(distinct, frequent, stopwords), "sentence-bounds")
        distinct = _may_win(distinct, bounds, max_sentences)
    winners = top_sentences(sentence_salience(distinct, counts, stopwords), max_sentences)
    largest = counts.groupBy("cafe_id").agg(F.max("n").alias("max_n"))
    scored = winners.join(largest, "cafe_id", "left").select(
        "cafe_id",
        "rank",
        "review_id",
        "sent_pos",
        "n_words",
        "weight",
        (F.col("weight") / F.coalesce("max_n", F.lit(1)) / (F.col("n_words") + F.lit(1))).alias(
            "score"
        ),
    )
    # A few rows a venue, written and met where the reviews are read: no text is shuffled while they are few enough.
    chosen = broadcast_if_small(written(scored, "summary-sentences"), MAX_CHOSEN)
    return reviews.select("review_id", "review_text").join(chosen, "review_id").select(
        "cafe_id",
        "rank",
        "review_id",
        "sent_pos",
        "n_words",
        "weight",
        "score",
        F.element_at(X.sentence_array(F.col("review_text")), F.col("sent_pos") + 1).alias(
            "sentence"
        ),
    )


def summary_text(chosen: DataFrame) -> DataFrame:
    """The chosen sentences of a venue joined by spaces, best first."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "sentence")))
    return chosen.groupBy("cafe_id").agg(
        F.array_join(F.transform(entries, lambda e: e["sentence"]), " ").alias("ai_summary")
    )


def summarize(reviews: DataFrame, max_sentences: int = 3, **options) -> DataFrame:
    """``(cafe_id, ai_summary)`` for every venue that has reviews.

    No sentence at all gives the "no reviews" text; only short sentences give ``''``.
    """
    texts = summary_text(summary_sentences(reviews, max_sentences, **options))
    has_text = reviews.groupBy("cafe_id").agg(
        F.max(X.has_text(F.col("review_text"))).alias("has_text")
    )
    return has_text.join(texts, "cafe_id", "left").select(
        "cafe_id", summary_or_default(F.col("ai_summary"), F.col("has_text")).alias("ai_summary")
    )


def summary_or_default(summary, has_text):
    return F.coalesce(summary, F.when(has_text, "").otherwise(vocab.NO_REVIEWS_SUMMARY))
