import random
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import venuelens as vl
from venuelens import vocab
from venuelens.operators.summary import distinct_sentences, sentence_salience
from venuelens.operators.terms import keyword_ranks


def by_id(df, value):
    return {r["cafe_id"]: r[value] for r in df.collect()}


def test_stats_and_left_join(spark, reviews_of):
    venues = spark.createDataFrame([(1,), (2,), (3,)], "cafe_id bigint")
    reviews = reviews_of((1, "a", 4.0), (1, None, None), (2, " ", 3.125), (9, "orphan", 1.0))
    rows = vl.with_review_stats(venues, vl.review_stats(reviews)).orderBy("cafe_id").collect()
    assert [tuple(r) for r in rows] == [
        (1, 2, 4.0, True), (2, 1, 3.12, False), (3, 0, None, False),
    ]


def test_keyword_ties_go_to_the_first_seen(reviews_of):
    reviews = reviews_of((1, "beta alpha beta alpha gamma"))
    assert by_id(vl.keywords(reviews, 2), "keywords") == {1: ["beta", "alpha"]}


def test_keywords_skip_short_words_and_stopwords(reviews_of):
    reviews = reviews_of((1, "very very very tea tea tea coffee"))
    assert by_id(vl.keywords(reviews), "keywords") == {1: ["coffee"]}


def brute_keywords(rows, n=6):
    counts, first = Counter(), {}
    at = 0
    for _, text in rows:
        for word in text.split():
            at += 1
            if word in vocab.STOPWORDS or len(word) < 4:
                continue
            counts[word] += 1
            first.setdefault(word, at)
    return sorted(counts, key=lambda w: (-counts[w], first[w]))[:n]


def hot_rows(seed, n):
    """A third of all reviews belongs to one venue, a third of those are copies."""
    rng = random.Random(seed)
    words = ["coffee", "latte", "music", "chairs", "window", "the", "tea", "crowd", "garden"]
    rows = []
    for i in range(n):
        cafe = 7 if i % 3 == 0 else rng.randrange(5)
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(4, 9)))
        rows.append((cafe, "coffee garden music the latte" if i % 9 == 0 else text))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_keywords_against_brute_force_on_a_hot_venue(reviews_of, parts):
    rows = hot_rows(3, 300)
    got = by_id(vl.keywords(reviews_of(*rows).repartition(parts)), "keywords")
    for cafe in {c for c, _ in rows}:
        assert got[cafe] == brute_keywords([r for r in rows if r[0] == cafe])


def brute_summary(texts, limit=3):
    """One sentence per text, no punctuation but the final stop."""
    counts = Counter(w for t in texts for w in t.rstrip(".").split() if w not in vocab.STOPWORDS)
    seen, scored = set(), []
    for i, t in enumerate(texts):
        words = t.rstrip(".").split()
        if t in seen or len(words) < 4:
            continue
        seen.add(t)
        scored.append((-sum(counts[w] for w in words) / (len(words) + 1), i, t))
    return " ".join(t for _, _, t in sorted(scored)[:limit])


@pytest.mark.parametrize("parts", [1, 5])
def test_summary_against_brute_force_on_a_hot_venue(reviews_of, parts):
    rows = [(c, t + ".") for c, t in hot_rows(5, 240)]
    got = by_id(vl.summarize(reviews_of(*rows).repartition(parts)), "ai_summary")
    for cafe in {c for c, _ in rows}:
        assert got[cafe] == brute_summary([t for c, t in rows if c == cafe])


def test_two_kinds_of_empty_summary(reviews_of):
    reviews = reviews_of((1, "Good. Nice."), (2, "  "), (3, None), (4, "Long enough to count here."))
    assert by_id(vl.summarize(reviews), "ai_summary") == {
        1: "", 2: vocab.NO_REVIEWS_SUMMARY, 3: vocab.NO_REVIEWS_SUMMARY, 4: "Long enough to count here.",
    }


def test_copies_count_as_words_but_appear_once(reviews_of):
    reviews = reviews_of((1, "Lovely garden with tea. LOVELY garden with tea."), (1, "Chairs and one window there."))
    rows = vl.summary_sentences(reviews).orderBy("rank").collect()
    assert [r["sentence"] for r in rows] == ["Lovely garden with tea.", "Chairs and one window there."]
    assert rows[0]["weight"] == 2 + 2 + 2 and rows[0]["n_words"] == 4
    assert rows[0]["score"] == 6 / 2 / 5


def test_only_stopwords_score_zero(reviews_of):
    rows = vl.summary_sentences(reviews_of((1, "this is the one of them"), (2, "これ は とても いい です"))).collect()
    assert sorted((r["cafe_id"], r["weight"], r["score"]) for r in rows) == [(1, 1, 1 / 7), (2, 0, 0.0)]


def test_sentences_without_words_do_not_share_a_join_key(reviews_of):
    reviews = reviews_of(*[(1, f"{i} 1 2 3 4.") for i in range(50)])
    weights = sentence_salience(distinct_sentences(reviews), vl.term_counts(reviews))
    assert weights.count() == 50 and weights.agg(F.max("weight")).first()[0] == 0


def test_listing_cuts_ratings_to_whole_stars(reviews_of):
    rows = vl.review_listing(reviews_of((1, "a", 4.9), (1, "b", None))).orderBy("review_id").collect()
    assert [r["stars"] for r in rows] == [4, None]


def test_word_counts_are_hashed_and_limited_before_the_venue_shuffle(reviews_of):
    reviews = reviews_of((1, "some words here"))
    assert "SortAggregate" not in plan_of(vl.term_counts(reviews))
    plan = plan_of(keyword_ranks(vl.term_counts(reviews)))
    assert plan.count("WindowGroupLimit") == 2
    assert "EvalPython" not in plan_of(vl.summarize(reviews))


def test_only_sentences_that_may_win_meet_all_counts(spark, monkeypatch):
    """Bounds from a few frequent words give the summary of the whole join, ties, small and unknown venues included."""
    from venuelens.operators import summary as M

    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [f"w{chr(97 + int(rng.paretovariate(0.6)) % 26)}{chr(97 + rng.randrange(3))}" for _ in range(rng.randrange(3, 9))]
        rows.append((i % 290, rng.choice([1, 1, 1, 2, None]), 1.0, " ".join(words) + ". " + " ".join(words[::-1])))
    rows += [(900, 3, 1.0, "one short remark here"), (901, 4, 1.0, "これ は とても いい です. 1 2 3 4 5"), (902, 5, 1.0, None)]
    reviews = spark.createDataFrame(rows, "review_id bigint, cafe_id bigint, rating double, review_text string")
    place = ["cafe_id", "review_id", "sent_pos", "n_words", "weight", "rank"]
    whole = M.top_sentences(M.sentence_salience(M.distinct_sentences(reviews), vl.term_counts(reviews)))
    want = {tuple(r) for r in whole.select(place).collect()}
    met, plain = [], M.sentence_salience
    monkeypatch.setattr(M, "sentence_salience", lambda d, *a: met.append(d.count()) or plain(d, *a))
    monkeypatch.setattr(M, "MAX_FREQUENT", 60)
    assert {tuple(r) for r in vl.summary_sentences(reviews).select(place).collect()} == want
    everything = M.distinct_sentences(reviews).count()
    assert met[0] < everything / 2
    monkeypatch.setattr(M, "MAX_FREQUENT", 1)  # more venues than that: all sentences meet all counts
    assert {tuple(r) for r in vl.summary_sentences(reviews).select(place).collect()} == want
    assert met[1] == everything
