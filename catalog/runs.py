"""One registered query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import venuelens as vl
from catalog import standins as S
from venuelens import schemas, vocab
from venuelens.functions.rounding import scaled_round
from venuelens.functions.scores import get_or, omit_missing
from venuelens.functions.text import spaced_token_count, word_array
from venuelens.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def joined(col: str | Column, sep: str = "|") -> Column:
    return F.array_join(col, sep)


def ten_places(col: str) -> Column:
    return scaled_round(F.col(col), 10).alias(col)


# -- cleaning ------------------------------------------------------------------


def clean_venues(spark, d):
    v = S.venues(spark, d)
    tags = vl.tags_array(F.col("purpose_tags"))
    return v.select(
        "cafe_id", "name", "area", "location", "budget", "budget_label", "atmosphere",
        "purpose_tags", joined(tags).alias("tags"), F.size(tags).alias("n_tags"), "noise_level",
        *vocab.FLAG_COLS, "overall_rating",
    )


def venues_csv(spark, d):
    """Every venue as a CSV line and back, with the options files are read with."""
    raw = S.raw_venues(spark, d)
    options = {"escape": '"', "multiLine": "true"}
    line = raw.select(F.to_csv(F.struct(*raw.columns), {"escape": '"'}).alias("line"))
    back = line.select(F.from_csv("line", schemas.VENUES_RAW.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return vl.clean_venues(back.select("r.*")).select(
        "cafe_id", "name", "budget_label", "purpose_tags", *vocab.FLAG_COLS,
        F.col("coffee_score").cast("double").alias("coffee_score"), "overall_rating",
    )


def _as_files(spark, df, name):
    """Delivered files: quoted CSV with a header, several of them, in a new shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def venues_files(spark, d):
    """Venues read from delivered CSV files."""
    path = _as_files(spark, S.raw_venues(spark, d), "venues-csv")
    return vl.clean_venues(vl.read_venues(spark, path)).select(
        "cafe_id", "name", "budget_label", "purpose_tags", *vocab.FLAG_COLS,
        F.col("coffee_score").cast("double").alias("coffee_score"), "overall_rating",
    )


def reviews_files(spark, d):
    """Reviews read from delivered CSV files, whose quoted texts hold line breaks."""
    path = _as_files(spark, S.reviews(spark, d).select("review_id", "cafe_id", "rating", "review_text"), "reviews-csv")
    return vl.read_reviews(spark, path).select("review_id", "cafe_id", "rating", "review_text")


def reviews_csv(spark, d):
    """Every review as a quoted CSV line and back: quotes and line breaks survive."""
    r = S.reviews(spark, d).select("review_id", "cafe_id", "rating", "review_text")
    line = r.select(
        F.to_csv(F.struct(*r.columns), {"escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line")
    )
    ddl = "review_id bigint, cafe_id bigint, rating double, review_text string"
    back = F.from_csv("line", ddl, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return line.select(back.alias("r")).select("r.*")


def budget_parse(spark, d):
    amount = vl.parse_budget_amount(F.col("budget_text"))
    return S.prefs(spark, d).select(
        "user_id", "budget_text", amount.alias("amount"), vl.budget_bucket(amount).alias("label")
    )


def facet_filter(spark, d):
    v = vl.facet_filter(S.venues(spark, d), outdoor=True, quiet=True, wifi=True)
    return v.select("cafe_id", "name", "noise_level")


def facet_filter_any(spark, d):
    """Any flag or column can be asked for."""
    v = vl.facet_filter(
        S.venues(spark, d), open_now=True, pet_friendly=True, charging_sockets=True,
        atmosphere="Rooftop", noise_level=None,
    )
    return v.select("cafe_id", "name", "atmosphere")


def budget_equality(spark, d):
    v = S.venues(spark, d)
    return vl.budget_filter(vl.budget_filter(v, "Under 700"), "Any").select("cafe_id", "budget_label")


def score_profile(spark, d):
    return vl.score_profile(S.venues(spark, d))


def venue_names(spark, d):
    return vl.venue_names(S.venues(spark, d))


def venues_by_name(spark, d):
    return vl.venues_by_name(S.venues(spark, d)).select("cafe_id", "name", "area")


# -- composite, leaderboards ---------------------------------------------------


def scored_venues(spark, d):
    return vl.composite_score(S.venues(spark, d))


def composite_all(spark, d):
    return scored_venues(spark, d).select("cafe_id", "ai_recommendation_score")


def _board(name: str) -> Query:
    def run(spark, d):
        out = vl.board(scored_venues(spark, d), name)
        scores = {"ai_recommendation_score", *vocab.SCORE_COLS}
        return out.select(
            "cafe_id", "name", "area", *[F.col(c).cast("double").alias(c) for c in out.columns if c in scores]
        )

    return run


def composite_top8(spark, d):
    """The flagship: best venues by composite with review count and mean rating."""
    v = vl.with_review_stats(scored_venues(spark, d), vl.review_stats(S.reviews(spark, d)))
    return vl.leaderboard(v, "ai_recommendation_score", 8).select(
        "cafe_id", "name", "ai_recommendation_score", "num_reviews", "avg_review_rating"
    )


def light_analysis(spark, d):
    """The analysis columns that need no text, for queries about joins and cards."""
    v = vl.with_review_stats(scored_venues(spark, d), vl.review_stats(S.reviews(spark, d)))
    summaries = vl.summarize(S.reviews(spark, d))
    return v.join(summaries, "cafe_id", "left").select(
        "cafe_id", "ai_recommendation_score", "num_reviews", "avg_review_rating",
        F.coalesce("ai_summary", F.lit(vocab.NO_REVIEWS_SUMMARY)).alias("ai_summary"),
    )


def dashboard_kpis(spark, d):
    stats = vl.with_review_stats(scored_venues(spark, d), vl.review_stats(S.reviews(spark, d)))
    return vl.dashboard_kpis(stats)


def review_stats(spark, d):
    v = vl.with_review_stats(S.venues(spark, d), vl.review_stats(S.reviews(spark, d)))
    return v.select("cafe_id", "num_reviews", "avg_review_rating", "has_text")


def venue_card(spark, d):
    return vl.venue_card(vl.enrich(S.venues(spark, d), light_analysis(spark, d)))


def venue_reviews(spark, d):
    return vl.review_listing(S.reviews(spark, d))


# -- text ------------------------------------------------------------------------


def sentences(spark, d):
    return vl.sentences(S.reviews(spark, d))


def tokens(spark, d):
    s = vl.sentences(S.reviews(spark, d))
    found = word_array(F.col("sentence"))
    return s.select(
        "review_id", "sent_pos", spaced_token_count(F.col("sentence")).alias("n_tokens"),
        F.size(found).alias("n_words"), joined(found, " ").alias("words"),
    )


def term_counts(spark, d):
    return vl.term_counts(S.reviews(spark, d)).select("cafe_id", "word", "n")


def keywords_top6(spark, d):
    return vl.keyword_table(S.reviews(spark, d))


def keyword_lists(spark, d):
    return vl.keywords(S.reviews(spark, d)).select("cafe_id", joined("keywords", " ").alias("keywords"))


def summary_sentences(spark, d):
    return vl.summary_sentences(S.reviews(spark, d))


def summary_text(spark, d):
    return vl.summarize(S.reviews(spark, d))


# -- sentiment, aspects --------------------------------------------------------


def sentence_sentiment(spark, d):
    return vl.score_sentences(vl.sentences(S.reviews(spark, d)), S.lexicon(spark), rules=None)


def sentence_sentiment_modifiers(spark, d):
    return vl.score_sentences(vl.sentences(S.reviews(spark, d)), S.lexicon(spark), rules=S.RULES)


def sentence_sentiment_idioms(spark, d):
    """Phrases that count as one word, and symbols that are read as their description."""
    return vl.score_sentences(
        vl.sentences(S.reviews(spark, d)), S.lexicon(spark), rules=S.RULES, phrases=S.phrases(spark), symbols=S.symbols(spark)
    )


def text_sentiment(spark, d):
    return vl.score_texts(S.reviews(spark, d), S.lexicon(spark), rules=S.RULES)


def aspect_mentions(spark, d):
    return vl.aspect_mentions(S.reviews(spark, d), S.ASPECTS)


def aspect_mentions_table(spark, d):
    """The named keywords, and every word of 6 to 12 letters that some review holds, by its first letter."""
    rows = [(aspect, word) for aspect, words in S.ASPECTS.items() for word in words]
    reviews = S.reviews(spark, d)
    words = reviews.select(F.explode(word_array(F.col("review_text"))).alias("keyword")).where(F.length("keyword").between(6, 12))
    keywords = words.distinct().select(F.substring("keyword", 1, 1).alias("aspect"), "keyword")
    named = spark.createDataFrame(rows, "aspect string, keyword string")
    return vl.aspect_mentions_from_table(reviews, named.union(keywords))


def _aspects(spark, d):
    return vl.aspect_by_review(S.reviews(spark, d), S.lexicon(spark), S.ASPECTS, rules=S.RULES)


def aspect_by_review(spark, d):
    return _aspects(spark, d).select("cafe_id", "review_id", "aspect", "n_sentences", ten_places("compound"))


def aspect_by_venue(spark, d):
    return vl.aspect_by_venue(_aspects(spark, d)).select(
        "cafe_id", "aspect", "n_reviews", ten_places("compound"), "score"
    )


def aspect_map(spark, d):
    return vl.aspect_rows(vl.aspect_map(vl.aspect_by_venue(_aspects(spark, d))))


def signed_model_score(spark, d):
    """A classifier's label and probability per document, here from the label table."""
    labels = S.table(spark, d, "labels").join(S.table(spark, d, "documents"), "doc_id")
    label = F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE")
    probability = (F.col("doc_id") % 50 + 50).cast("double") / 100
    return labels.select(
        "doc_id", "quality", F.length("text").alias("n_read"),
        vl.signed_score(label, probability).alias("compound"),
    )


def conversation_scores(spark, d):
    """The scorer hook on conversation turns: any function that adds ``compound``."""
    turns = S.table(spark, d, "conversations").select(
        F.col("conv_id").alias("review_id"), F.col("turn").alias("sent_pos"), "role",
        F.col("text").alias("sentence"),
    )

    def classify(text: Column) -> Column:
        return F.struct(
            F.when(F.contains(F.lower(text), F.lit("tion")), "POSITIVE").otherwise("NEGATIVE").alias("label"),
            (F.length(text) / F.lit(512.0)).alias("score"),
        )

    return vl.score_sentences(turns, scorer=vl.classifier_scorer(classify))


# -- analysis --------------------------------------------------------------------


def analysis(spark, d, **options):
    return vl.analyze(
        S.venues(spark, d), S.reviews(spark, d), S.lexicon(spark), S.ASPECTS, rules=S.RULES, **options
    )


def analysis_full(spark, d):
    entry = F.transform(
        F.array_sort(F.map_entries("aspect_sentiment_10")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return analysis(spark, d).withColumns(
        {
            "aspect_sentiment_10": joined(entry, ","),
            "keywords": joined("keywords", " "),
            **{c: F.col(c).cast("double") for c in vocab.SCORE_COLS},
        }
    )


def analysis_json(spark, d):
    return vl.analysis_to_json(analysis(spark, d))


def _report(part: str) -> Query:
    def run(spark, d):
        report = vl.report_of(
            S.venues(spark, d), S.reviews(spark, d), S.lexicon(spark), aspects=S.ASPECTS, rules=S.RULES
        )
        return getattr(report, part)

    return run


# -- recommendation --------------------------------------------------------------


def _places(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("features").alias("place", "value"))


def venue_features(spark, d):
    return _places(vl.encode_venues(S.venues(spark, d)), "cafe_id")


def pref_features(spark, d):
    return _places(vl.encode_prefs(S.prefs(spark, d)), "user_id")


def pref_map(spark, d):
    """Settings held in a map: defaults for missing keys, empty entries left out."""
    prefs = S.prefs(spark, d)
    settings = omit_missing(F.create_map(F.lit("coffee"), "coffee", F.lit("dessert"), "dessert"))
    return prefs.select("user_id", settings.alias("settings")).select(
        "user_id", F.size("settings").alias("n_set"),
        get_or(F.col("settings"), "coffee", 0.8).alias("coffee"),
        get_or(F.col("settings"), "wifi", 0.5).alias("wifi"),
    )


def recommend_cosine(spark, d):
    return vl.recommend(S.venues(spark, d), S.prefs(spark, d))


def recommend_knn(spark, d):
    return vl.recommend(S.venues(spark, d), S.prefs(spark, d), method="knn")


def recommend_budget(spark, d):
    return vl.recommend(S.venues(spark, d), S.prefs(spark, d), match_budget=True)


def recommend_levels(spark, d):
    """The same ranking through two block levels, for one label."""
    return vl.recommend(
        S.venues(spark, d), S.prefs(spark, d), k=3, budget_label="Under 700", widths=(5.0, 2.0)
    )


def recommend_enriched(spark, d):
    out = vl.recommend_enriched(
        S.venues(spark, d), S.prefs(spark, d), light_analysis(spark, d), match_budget=True
    )
    return out.select(
        "user_id", "rank", "cafe_id", "name", "atmosphere", "purpose_tags", "match_score",
        "ai_recommendation_score", "num_reviews", "avg_review_rating", "ai_summary",
    )


def text_keys(spark, d):
    """Keys that are text, from the reviews to the summary."""
    reviews = S.reviews(spark, d, text_keys=True)
    v = vl.with_review_stats(vl.clean_venues(S.raw_venues(spark, d, text_keys=True)), vl.review_stats(reviews))
    return v.join(vl.summarize(reviews), "cafe_id", "left").select("cafe_id", "num_reviews", "avg_review_rating", "ai_summary")


def text_keys_recommend(spark, d):
    venues = vl.clean_venues(S.raw_venues(spark, d, text_keys=True))
    prefs = S.prefs(spark, d).withColumn("user_id", F.concat(F.lit("U"), "user_id"))
    return vl.recommend(venues, prefs)


def recommend_budget_any(spark, d):
    """Budgets that are null, empty, 'Any', or a label that only some venues have."""
    own = F.when(F.col("cafe_id") % 9 == 0, "Terrace deal").otherwise(F.col("budget_label"))
    u = F.col("user_id") % 5
    asked = F.when(u == 1, "").when(u == 2, "Any").when(u == 3, "Terrace deal").when(u == 4, "Under 700")
    return vl.recommend(
        S.venues(spark, d).withColumn("budget_label", own), S.prefs(spark, d).withColumn("budget", asked), match_budget=True
    )


def submit_form_facets(spark, d):
    """Every user with check boxes of their own."""
    u = F.col("user_id")
    prefs = S.prefs(spark, d).withColumns({"want_outdoor": u % 2 == 0, "want_quiet": F.when(u % 3 > 0, u % 3 == 1), "want_wifi": u % 5 < 2})
    out = vl.submit_form(S.venues(spark, d), prefs, light_analysis(spark, d))
    return out.select("user_id", "rank", "cafe_id", "match_score")


def venue_features_list_tags(spark, d):
    """Tags that are stored as a list."""
    v = S.raw_venues(spark, d).withColumn("purpose_tags", F.split("purpose_tags", "[,|]"))
    return _places(vl.encode_venues(vl.clean_venues(v)), "cafe_id")


def enrich_aspects(spark, d):
    entry = F.transform(
        F.array_sort(F.map_entries("aspect_sentiment_10")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return vl.enrich(S.venues(spark, d), analysis(spark, d)).select(
        "cafe_id", "name", joined(entry, ",").alias("aspect_sentiment_10"), "num_reviews"
    )


def submit_form(spark, d):
    out = vl.submit_form(
        S.venues(spark, d), S.prefs(spark, d), light_analysis(spark, d), outdoor=True, wifi=True
    )
    return out.select("user_id", "rank", "cafe_id", "match_score", "num_reviews")


def match_counts(spark, d):
    pool = vl.facet_filter(S.venues(spark, d), outdoor=True, quiet=True, atmosphere="Luxury")
    return vl.match_counts(vl.recommend(pool, S.prefs(spark, d), match_budget=True))


def match_counts_all(spark, d):
    """The same for every user, zero for those whose budget no venue of the pool has."""
    pool = vl.facet_filter(S.venues(spark, d), outdoor=True, quiet=True, atmosphere="Luxury").where("budget_label <> 'Above 2000'")
    return vl.match_counts(vl.recommend(pool, S.prefs(spark, d), match_budget=True), S.prefs(spark, d))


def vector_knn(spark, d):
    """The five stored vectors nearest to the mean direction of each label."""
    stored = S.table(spark, d, "embeddings")
    queries = vl.mean_directions(stored, "label", "embedding", "query").withColumnRenamed("label", "query_id")
    return vl.nearest(stored, queries, 5).withColumn("similarity", scaled_round(F.col("similarity"), 9))


def vector_cosine(spark, d):
    """Similarity of every stored vector to the mean direction of its label."""
    stored = S.table(spark, d, "embeddings")
    means = vl.mean_directions(stored, "label", "embedding")
    sim = vl.cosine(F.col("embedding").cast("array<double>"), F.col("direction"))
    return stored.join(means, "label").select("vec_id", "label", scaled_round(sim, 9).alias("similarity"))


QUERIES: dict[str, Query] = {
    "clean_venues": clean_venues,
    "venues_csv": venues_csv,
    "reviews_csv": reviews_csv,
    "reviews_files": reviews_files,
    "venues_files": venues_files,
    "budget_parse": budget_parse,
    "facet_filter": facet_filter,
    "facet_filter_any": facet_filter_any,
    "budget_equality": budget_equality,
    "score_profile": score_profile,
    "venue_names": venue_names,
    "venues_by_name": venues_by_name,
    "composite_all": composite_all,
    "composite_top8": composite_top8,
    "leaderboard_trending": _board("trending"),
    "leaderboard_instagram": _board("instagram"),
    "leaderboard_study": _board("study"),
    "leaderboard_date": _board("date"),
    "leaderboard_coffee": _board("coffee"),
    "leaderboard_budget": _board("budget"),
    "dashboard_kpis": dashboard_kpis,
    "review_stats": review_stats,
    "venue_card": venue_card,
    "venue_reviews": venue_reviews,
    "sentences": sentences,
    "tokens": tokens,
    "term_counts": term_counts,
    "keywords_top6": keywords_top6,
    "keyword_lists": keyword_lists,
    "summary_sentences": summary_sentences,
    "summary_text": summary_text,
    "sentence_sentiment": sentence_sentiment,
    "sentence_sentiment_modifiers": sentence_sentiment_modifiers,
    "sentence_sentiment_idioms": sentence_sentiment_idioms,
    "text_sentiment": text_sentiment,
    "aspect_mentions": aspect_mentions,
    "aspect_mentions_table": aspect_mentions_table,
    "aspect_by_review": aspect_by_review,
    "aspect_by_venue": aspect_by_venue,
    "aspect_map": aspect_map,
    "signed_model_score": signed_model_score,
    "conversation_scores": conversation_scores,
    "analysis_full": analysis_full,
    "analysis_json": analysis_json,
    "venue_report_header": _report("header"),
    "venue_report_scores": _report("scores"),
    "venue_report_aspects": _report("aspects"),
    "venue_report_reviews": _report("reviews"),
    "venue_features": venue_features,
    "pref_features": pref_features,
    "pref_map": pref_map,
    "recommend_cosine": recommend_cosine,
    "recommend_knn": recommend_knn,
    "recommend_budget": recommend_budget,
    "recommend_levels": recommend_levels,
    "recommend_enriched": recommend_enriched,
    "submit_form": submit_form,
    "match_counts": match_counts,
    "match_counts_all": match_counts_all,
    "text_keys": text_keys,
    "text_keys_recommend": text_keys_recommend,
    "recommend_budget_any": recommend_budget_any,
    "submit_form_facets": submit_form_facets,
    "venue_features_list_tags": venue_features_list_tags,
    "enrich_aspects": enrich_aspects,
    "vector_knn": vector_knn,
    "vector_cosine": vector_cosine,
}
