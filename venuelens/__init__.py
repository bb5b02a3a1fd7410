"""Venue recommendation and review analytics as Spark jobs."""

from venuelens.functions.clean import (
    budget_bucket,
    budget_label,
    normalize_tags,
    parse_budget_amount,
    parse_flags,
    tag_list,
    tags_array,
    with_budget_label,
)
from venuelens.functions.scores import score_to_ten, signed_score
from venuelens.functions.vectors import cosine
from venuelens.operators.aspects import (
    aspect_by_review,
    aspect_by_venue,
    aspect_map,
    aspect_mentions,
    aspect_mentions_from_table,
)
from venuelens.operators.composite import composite_score
from venuelens.operators.features import encode_prefs, encode_venues
from venuelens.operators.filters import (
    budget_filter,
    facet_filter,
    reviews_of,
    venue_names,
    venues_by_name,
)
from venuelens.operators.nearest import mean_directions, nearest
from venuelens.operators.ranking import leaderboard
from venuelens.operators.recommend import attach_venues, recommend
from venuelens.operators.reshape import aspect_rows, score_profile
from venuelens.operators.reviews import review_listing, review_stats, with_review_stats
from venuelens.operators.sentiment import (
    SentimentRules,
    classifier_scorer,
    score_sentences,
    score_texts,
)
from venuelens.operators.summary import summarize, summary_sentences
from venuelens.operators.terms import keyword_table, keywords, sentences, term_counts, words
from venuelens.plans.analysis import analyze, duplicate_keys, enrich
from venuelens.plans.cards import venue_card
from venuelens.plans.dashboard import board, dashboard_kpis
from venuelens.plans.recommendations import match_counts, recommend_enriched, submit_form
from venuelens.plans.report import VenueReport, report_of, venue_report
from venuelens.sources.tables import (
    analysis_to_json,
    clean_venues,
    load,
    read_prefs,
    read_reviews,
    read_venues,
    to_parquet,
    write_analysis_json,
)

__all__ = [name for name in dir() if not name.startswith("_")]
