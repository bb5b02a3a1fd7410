"""Vocabularies shared by every operator.

All of them are defaults: each operator that uses one takes it as a parameter.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Word lists, labels, weights and limits that results depend on.

ATMOSPHERES = ["Minimal", "Heritage", "Rooftop", "Luxury", "Artsy", "Nature"]
PURPOSES = ["Study", "Date", "Friends", "Solo", "Work"]

BUDGET_LABELS = ["Under 700", "700 to 2000", "Above 2000"]
BUDGET_SYMBOLS = {"₹": "Under 700", "₹₹": "700 to 2000", "₹₹₹": "Above 2000"}
BUDGET_MAP = {"Under 700": 1, "700 to 2000": 2, "Above 2000": 3}
DEFAULT_BUDGET_ORDINAL = 2
DEFAULT_BUDGET_AMOUNT = 700
LOW_BUDGET_LIMIT = 700
MID_BUDGET_LIMIT = 2000
ANY_BUDGET = "Any"

SCORE_COLS = [
    "coffee_score",
    "dessert_score",
    "study_score",
    "date_score",
    "instagram_score",
    "wifi_score",
]
PRIORITY_DEFAULTS = {
    "coffee": 0.8,
    "dessert": 0.6,
    "study": 0.5,
    "date": 0.5,
    "instagram": 0.5,
    "wifi": 0.5,
}
# Terms are added in this order, so the floating-point sum is fixed.
COMPOSITE_WEIGHTS = {
    "coffee_score": 0.20,
    "dessert_score": 0.15,
    "study_score": 0.15,
    "instagram_score": 0.15,
    "date_score": 0.15,
    "wifi_score": 0.20,
}

FLAG_COLS = ["pet_friendly", "outdoor_seating", "charging_sockets", "free_wifi", "open_now"]
QUIET_NOISE_LEVEL = "Low"

SHORT_SCORE_LABELS = {
    "coffee_score": "Coffee",
    "dessert_score": "Dessert",
    "study_score": "Study",
    "date_score": "Date",
    "instagram_score": "Instagram",
    "wifi_score": "Wi-Fi",
}
DETAIL_SCORE_LABELS = {
    "coffee_score": "Coffee Quality",
    "dessert_score": "Dessert Rating",
    "study_score": "Study Friendly",
    "date_score": "Date Friendly",
    "instagram_score": "Instagram Score",
    "wifi_score": "Wi-Fi Quality",
}

NO_REVIEWS_SUMMARY = "No reviews available yet."
NO_SUMMARY = "No summary available."
NO_RATING = "N/A"

ASPECT_KEYWORDS = {
    "coffee": [
        "coffee", "espresso", "latte", "cappuccino", "brew", "americano", "filter coffee",
        "flat white",
    ],
    "dessert": [
        "dessert", "cake", "pastry", "pastries", "sweet", "cheesecake", "brownie", "waffle",
    ],
    "wifi": ["wifi", "wi-fi", "internet", "connection", "network"],
    "service": [
        "service", "staff", "server", "waiter", "waitress", "attentive", "hospitality",
    ],
    "ambience": [
        "ambience", "ambiance", "decor", "vibe", "aesthetic", "interior", "photogenic",
        "instagram", "lighting",
    ],
    "price": [
        "price", "expensive", "cheap", "pocket", "value", "cost", "budget", "affordable",
    ],
    "noise": ["noise", "noisy", "quiet", "peaceful", "loud", "calm", "crowded"],
}

STOPWORDS = (
    "a an the this that these those is are was were be been being have has had do does did "
    "will would shall should can could may might must to of in on at by for with about "
    "against between into through during before after above below from up down out off over "
    "under again further then once here there all any both each few more most other some such "
    "no nor not only own same so than too very s t just don now i we you he she it they them "
    "their his her its our your my me and or but if while as"
).split()
# --- end of fixed values ----------------------------------------------------

PRIORITIES = list(PRIORITY_DEFAULTS)
