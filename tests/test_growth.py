"""Results of the steps that were changed for large tables, and what their plans must not hold."""

import random
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import venuelens as vl
from venuelens.functions import text as X
from venuelens.operators import sentiment, summary, terms
from venuelens.operators.aspects import aspect_sentences

WIDE = [0, 5, -5, 2**32 - 1, 2**32, -(2**32), -(2**32) - 1, 2**63 - 1, -(2**63), None]


def test_words_are_counted_once(spark, reviews_of, monkeypatch):
    from venuelens.plans import analysis

    calls = []
    for module in (analysis, summary):
        monkeypatch.setattr(module, "term_counts", lambda *a, **k: calls.append(1) or terms.term_counts(*a, **k))
    venues = spark.createDataFrame(
        [(1, "A", "₹", "Low", *[8.0] * 7)],
        "cafe_id bigint, name string, budget string, noise_level string, "
        + ", ".join(f"{c} double" for c in [*vl.vocab.SCORE_COLS, "overall_rating"]),
    )
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    row = vl.analyze(venues, reviews_of((1, "The good coffee is good here.", 4.0)), lexicon).first()
    assert row["keywords"] == ["good", "coffee"] and row["ai_summary"] == "The good coffee is good here."
    assert len(calls) == 1


@pytest.mark.parametrize("seed", range(3))
def test_positions_of_narrow_and_wide_ids(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(WIDE), rng.randrange(2), 1.0, " ".join(rng.choice("abcd") for _ in range(5))) for _ in range(60)]
    reviews = spark.createDataFrame(rows, "review_id bigint, cafe_id bigint, rating double, review_text string")
    plain = F.min(X.position(F.col("review_id"), F.col("word_pos")))
    both = terms.words(reviews).groupBy("cafe_id", "word").agg(plain.alias("plain"), terms.first_position(reviews, "word_pos").alias("found"))
    assert both.schema["plain"].dataType == both.schema["found"].dataType
    assert both.where(~F.col("plain").eqNullSafe(F.col("found"))).count() == 0 < both.count()


def test_words_of_one_count_stay_together(spark):
    rng = random.Random(1)
    rows = [(c, f"w{i}", rng.randrange(1, 9)) for c in range(4) for i in range(40)] + [(9, "a", 2), (9, "b", 2), (None, "a", 7)]
    counts = spark.createDataFrame(rows, "cafe_id bigint, word string, n bigint")
    levels = summary._counts_of_counts(counts)
    for most in (1, 12, 100):
        out = summary._frequent_words(counts, levels, most)
        got = out.collect()
        for cafe in (0, 1, 2, 3, 9):
            mine = {w: n for c, w, n in rows if c == cafe}
            taken = {r.word: r.n for r in got if r.cafe_id == cafe and r.word is not None}
            rest = {r.rest for r in got if r.cafe_id == cafe}
            others = [n for w, n in mine.items() if w not in taken]
            assert len(taken) <= most and taken.items() <= mine.items()
            assert rest == {max(others, default=0)} and all(n > max(others, default=0) for n in taken.values())
    assert "Window" not in plan_of(out)  # the counts are not ranked
    assert Counter(r.cafe_id for r in got if r.word is None) == Counter([0, 1, 2, 3, 9, None])


def test_a_venue_without_frequent_words_is_bounded(reviews_of, monkeypatch):
    """All words of a venue occur equally often, more of them than are broadcast."""
    reviews = reviews_of((1, "aa bb cc dd. ee ff gg hh. ii jj kk ll. mm nn oo pp qq. the the the the"), (2, "one two three four"))
    want = {tuple(r) for r in vl.summary_sentences(reviews).collect()}
    monkeypatch.setattr(summary, "MAX_FREQUENT", 4)
    assert {tuple(r) for r in vl.summary_sentences(reviews).collect()} == want
    assert any(r[6] and r[7].startswith("mm") for r in want)


def test_bare_tokens(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("ab.!'é#-Σß１€。") for _ in range(rng.randrange(1, 8))) for _ in range(500)] + ["", "...", "x", "(ab)", "(abc)"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    wrong = df.where(X.bare_token(F.col("t")) != X.without_outer_punctuation(F.col("t")))
    assert wrong.collect() == []


def test_sentences_are_lowered_once(reviews_of):
    """A filter on the keywords would put the sentence in lower case for each of them."""
    reviews = reviews_of((1, "Good COFFEE. Loud room. Nothing else"), (1, "Price and coffee"))
    df = aspect_sentences(reviews, {"a": ["coffee", "tea"], "b": ["loud", "price"]})
    assert sorted((r.sentence, r.touched0) for r in df.collect()) == [("Good COFFEE.", 1), ("Loud room.", 2), ("Price and coffee", 3)]
    filters = [line for line in plan_of(df).splitlines() if "Filter" in line]
    assert filters and not any("lower(" in line.split("Filter")[1] for line in filters)


def test_contrast_and_capitals_in_outer_punctuation(spark, reviews_of):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")

    def score(text, rules=sentiment.DEFAULT_RULES):
        return vl.score_texts(reviews_of((1, text)), lexicon, rules=rules).first()["compound"]

    assert score("bad (but) good") == score("bad but good") != score("bad butter good")
    assert score("it is 'GOOD', yes") > score("it is good yes")
    assert score("it is VERY, good") > score("it is very good") > score("it is good")
    assert score("GOOD") == score("good") and score("“but” nothing") == 0
