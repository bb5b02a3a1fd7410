"""The full per-venue analysis: statistics, aspects, summary, keywords, composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.operators.aspects import aspect_by_review, aspect_by_venue, aspect_map
from venuelens.operators.composite import composite_score
from venuelens.operators.reviews import review_stats, with_review_stats
from venuelens.operators.summary import summary_or_default, summary_sentences, summary_text
from venuelens.operators.terms import keyword_ranks, term_counts
from venuelens.session import written

ANALYSIS_COLS = [
    "cafe_id",
    "name",
    "num_reviews",
    "avg_review_rating",
    "overall_rating",
    *vocab.SCORE_COLS,
    "noise_level",
    "budget",
    "ai_recommendation_score",
    "aspect_sentiment_10",
    "ai_summary",
    "keywords",
]

_NO_ASPECTS = "map<string,double>"
_NO_WORDS = "array<string>"


def analyze(
    venues: DataFrame,
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    aspects: dict[str, list[str]] = vocab.ASPECT_KEYWORDS,
    stopwords: list[str] = vocab.STOPWORDS,
    max_sentences: int = 3,
    top_n: int = 6,
    longer_than: int = 3,
    write_counts: bool = True,
    **scoring,
) -> DataFrame:
    """One row per venue with the 17 analysis columns; venues without reviews are kept.

    ``cafe_id`` has to be unique in ``venues`` and ``review_id`` in ``reviews``.  Every
    part is aggregated by venue on its own and joined by ``cafe_id``; reviews of unknown
    venues fall out in that join.  The word counts are stored once as a table in the shared folder with
    their places, for keywords and summary alike; ``write_counts=False`` counts twice instead.
    """
    counts = term_counts(reviews, stopwords)
    if write_counts:
        counts = written(counts, "term-counts")
    ranked = keyword_ranks(counts.filter(F.length("word") > longer_than), top_n)
    words = F.array_sort(F.collect_list(F.struct("rank", "word")))
    keyword_lists = ranked.groupBy("cafe_id").agg(
        F.transform(words, lambda e: e["word"]).alias("keywords")
    )
    summaries = summary_text(
        summary_sentences(reviews, max_sentences, stopwords=stopwords, counts=counts if write_counts else None)
    )
    per_aspect = aspect_map(aspect_by_venue(aspect_by_review(reviews, lexicon, aspects, **scoring)))
    return (
        with_review_stats(composite_score(venues), review_stats(reviews))
        .join(per_aspect, "cafe_id", "left")
        .join(summaries, "cafe_id", "left")
        .join(keyword_lists, "cafe_id", "left")
        .withColumns(
            {
                "ai_summary": summary_or_default(F.col("ai_summary"), F.col("has_text")),
                "aspect_sentiment_10": F.coalesce(
                    "aspect_sentiment_10", F.create_map().cast(_NO_ASPECTS)
                ),
                "keywords": F.coalesce("keywords", F.array().cast(_NO_WORDS)),
            }
        )
        .select(*ANALYSIS_COLS)
    )


def enrich(venues: DataFrame, analysis: DataFrame) -> DataFrame:
    """Venues with the analysis columns the dashboard and the cards show."""
    return venues.join(shown_analysis(analysis), "cafe_id")


def shown_analysis(analysis: DataFrame) -> DataFrame:
    """The analysis columns to show; the aspect map is there unless the analysis has none."""
    shown = ["cafe_id", "ai_recommendation_score", "ai_summary", "num_reviews", "avg_review_rating"]
    return analysis.select(*shown, *[c for c in ("aspect_sentiment_10",) if c in analysis.columns])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once: empty when the table is usable."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
