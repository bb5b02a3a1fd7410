"""Sentences, words and keyword ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens import vocab
from venuelens.functions import text as X


def sentences(reviews: DataFrame) -> DataFrame:
    """One row per sentence: ``(cafe_id, review_id, sent_pos, sentence)``."""
    return reviews.select(
        "cafe_id",
        "review_id",
        F.posexplode(X.sentence_array(F.col("review_text"))).alias("sent_pos", "sentence"),
    )


def words(reviews: DataFrame) -> DataFrame:
    """One row per word: ``(cafe_id, review_id, word_pos, word)``."""
    return reviews.select(
        "cafe_id",
        "review_id",
        F.posexplode(X.word_array(F.col("review_text"))).alias("word_pos", "word"),
    )


def has_text_key(reviews: DataFrame) -> bool:
    return isinstance(reviews.schema["review_id"].dataType, T.StringType)


def first_position(reviews: DataFrame, offset: str) -> Column:
    """Aggregate: the smallest position of a group, as ``min(position)`` gives it.

    Ids of up to 32 bits, and a sign, are compared as one long; only others pay for wide decimals in every row.
    """
    review_id, at = F.col("review_id"), F.col(offset)
    if not isinstance(reviews.schema["review_id"].dataType, T.IntegralType):
        return F.min(X.position(review_id, at, has_text_key(reviews)))
    narrow = review_id.between(-(2**32), 2**32 - 1)
    return F.least(
        F.min(F.when(narrow, X.narrow_position(review_id, at))).cast("decimal(30,0)"),
        F.min(F.when(~narrow, X.position(review_id, at))),
    )


def not_stopword(word: Column, stopwords: Iterable[str]) -> Column:
    return ~word.isin(*stopwords)


def term_counts(
    reviews: DataFrame, stopwords: Iterable[str] = tuple(vocab.STOPWORDS), min_length: int = 1
) -> DataFrame:
    """Occurrences per (venue, word) that is no stopword, and where the word comes first.

    Counts are combined inside each map task before anything is shuffled, and the
    shuffle key is (venue, word): a venue with a third of all reviews is spread over
    its words.
    """
    kept = words(reviews).filter(
        not_stopword(F.col("word"), stopwords) & (F.length("word") >= min_length)
    )
    return kept.groupBy("cafe_id", "word").agg(
        F.count("*").alias("n"),
        first_position(reviews, "word_pos").alias("first_at"),
    )


def keyword_ranks(counts: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` most frequent words of each venue; ties go to the earlier first occurrence.

    The limit on the rank is applied per task before the shuffle by venue.
    """
    order = Window.partitionBy("cafe_id").orderBy(F.col("n").desc(), F.col("first_at"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("cafe_id", "rank", "word", "n")
    )


def keyword_table(
    reviews: DataFrame,
    n: int = 6,
    stopwords: Iterable[str] = tuple(vocab.STOPWORDS),
    longer_than: int = 3,
) -> DataFrame:
    """Keyword ranks straight from the reviews."""
    return keyword_ranks(term_counts(reviews, stopwords, longer_than + 1), n)


def keywords(
    reviews: DataFrame,
    n: int = 6,
    stopwords: Iterable[str] = tuple(vocab.STOPWORDS),
    longer_than: int = 3,
) -> DataFrame:
    """One ``keywords`` array per venue, most frequent first (at most ``n`` entries)."""
    ranked = keyword_table(reviews, n, stopwords, longer_than)
    entries = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy("cafe_id").agg(F.transform(entries, lambda e: e["word"]).alias("keywords"))
