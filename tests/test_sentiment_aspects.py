import math
import random
import re
import time

import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

import venuelens as vl
from venuelens.operators.aspects import aspect_mentions_from_table

LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("hardly", 0.4)]


def test_no_with_a_valence_only_turns_what_follows(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("no", -1.2)], "token string, valence double")
    texts = {"no good here": 1.9 * -0.74, "no x here": -1.2, "x no": -1.2}
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    scored = vl.score_sentences(spark.createDataFrame(rows, "review_id bigint, sent_pos int, sentence string"), lexicon)
    assert [r.compound for r in scored.orderBy("review_id").collect()] == [squeeze(v) for v in texts.values()]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, valence double")


def squeeze(total):
    return round(total / math.sqrt(total * total + 15), 4)


CASES = {
    "the room was good": 1.9,
    "nothing here": 0.0,
    "good bad": 1.9 - 2.5,
    "very good": 1.9 + 0.293,
    "very bad": -2.5 - 0.293,
    "slightly good": 1.9 - 0.293,
    "very x good": 1.9 + 0.293 * 0.95,
    "very x y good": 1.9 + 0.293 * 0.9,
    "very x y z good": 1.9,
    "not good": 1.9 * -0.74,
    "wasn't x y good": 1.9 * -0.74,
    "not very good": (1.9 + 0.293) * -0.74,
    "never so good": (1.9 + 0.293) * 1.25,
    "never this x good": 1.9 * 1.25,
    "never good": 1.9 * -0.74,
    "without doubt good": 1.9,
    "without any doubt good": 1.9,
    "without x good": 1.9 * -0.74,
    "least good": 1.9 * -0.74,
    "at least good": 1.9,
    "no good": 1.9 * -0.74,
    "no x good": 1.9 * -0.74,
    "no x or good": 1.9 * -0.74,
    "no x y good": 1.9,
    "GOOD coffee": 1.9 + 0.733,
    "GOOD COFFEE": 1.9,
    "BAD coffee": -2.5 - 0.733,
    "VERY good": 1.9 + 0.293 + 0.733,
    "good!": 1.9 + 0.292,
    "good!!!!!!": 1.9 + 4 * 0.292,
    "bad!": -2.5 - 0.292,
    "nothing!": 0.0,
    "good?": 1.9,
    "good??": 1.9 + 0.36,
    "good????": 1.9 + 0.96,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
    "(great), really": 3.1,
    # a degree word is never a sentiment word itself, and as a known word it lifts nothing
    "hardly": 0.0,
    "hardly good": 1.9,
}


def test_rules(spark, lexicon):
    rows = [(i, 0, s) for i, s in enumerate(CASES)]
    sentences = spark.createDataFrame(rows, "review_id bigint, sent_pos int, sentence string")
    got = {r["review_id"]: r["compound"] for r in vl.score_sentences(sentences, lexicon).collect()}
    for i, (sentence, total) in enumerate(CASES.items()):
        assert got[i] == pytest.approx(squeeze(total), abs=1e-9), sentence


def test_a_large_lexicon_is_joined_by_shuffle(spark, lexicon, monkeypatch):
    from venuelens.operators import sentiment

    monkeypatch.setattr(sentiment, "MAX_BROADCAST_TOKENS", 1)
    test_rules(spark, lexicon)


PHRASES = [("kiss of death", -1.5), ("To  Die For", 3.0), ("to die", -2.9), ("die for good", 1.0), ("bad", 0.5), (None, 1.0), ("x y", None)]
IDIOMS = {
    "a kiss of death": -1.5,
    "KISS of Death, really": -1.5,
    "kiss of life": 0.0,
    "to die for": 3.0,
    "to die here": -2.9,
    # from left to right: the words of the first match are used up
    "to die for good": 3.0 + 1.9,
    "die for good": 1.0,
    "not to die for": 3.0 * -0.74,
    "very much to die for": 3.0 + 0.293 * 0.95,
    "good to die to die for bad": 1.9 - 2.9 + 3.0 + 0.5,
    "TO DIE FOR cake": 3.0 + 0.733,
    "x y": 0.0,
    "good 😀": 1.9 + 3.1,
    "😀😀": 2 * 3.1,
    "not😀": 3.1 * -0.74,
    "so 👍🏽 good": 1.9 + 0.293 * 0.95,
    "☠ for": 3.0,
}
SYMBOLS = [("😀", "great"), ("👍", "bad"), ("👍🏽", "thumb"), ("☠", "to die"), ("", "bad"), (None, "bad")]


def test_idioms_and_emoji(spark, lexicon):
    rows = [(i, 0, s) for i, s in enumerate(IDIOMS)]
    sentences = spark.createDataFrame(rows, "review_id bigint, sent_pos int, sentence string")
    phrases = spark.createDataFrame(PHRASES, "phrase string, valence double")
    symbols = spark.createDataFrame(SYMBOLS, "symbol string, description string")
    scored = vl.score_sentences(sentences, lexicon, phrases=phrases, symbols=symbols)
    got = {r["review_id"]: r["compound"] for r in scored.collect()}
    for i, (sentence, total) in enumerate(IDIOMS.items()):
        assert got[i] == pytest.approx(squeeze(total), abs=1e-9), sentence
    core = vl.score_sentences(sentences.where("review_id = 7"), lexicon, rules=None, phrases=phrases)
    assert core.first()["compound"] == squeeze(3.0)
    plain = vl.score_sentences(sentences, lexicon, phrases=phrases.limit(0), symbols=symbols.limit(0))
    assert sorted(plain.collect()) == sorted(vl.score_sentences(sentences, lexicon).collect())


def test_phrases_are_merged_from_the_left_longest_first(spark):
    """Against a plain scan, over few words that overlap a lot."""
    from venuelens.operators.sentiment import merge_phrases

    rng = random.Random(24)
    phrases = sorted({" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(14)})
    texts = [[rng.choice("abcABd") for _ in range(rng.randrange(0, 25))] for _ in range(300)]

    def plain(tokens):
        out, at = [], 0
        while at < len(tokens):
            n = max((len(p.split()) for p in phrases if [t.lower() for t in tokens[at : at + len(p.split())]] == p.split()), default=1)
            out.append(" ".join(tokens[at : at + n]))
            at += n
        return out

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, tokens array<string>")
    frame = frame.withColumn("lows", F.transform("tokens", F.lower))
    got = dict(frame.select("i", merge_phrases(F.col("tokens"), F.col("lows"), phrases)).collect())
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_phrase_tables_are_bounded(spark, lexicon, monkeypatch):
    from venuelens.operators import sentiment

    monkeypatch.setattr(sentiment, "MAX_PHRASES", 2)
    sentences = spark.createDataFrame([(1, 0, "x")], "review_id bigint, sent_pos int, sentence string")
    with pytest.raises(ValueError):
        vl.score_sentences(sentences, lexicon, phrases=spark.createDataFrame(PHRASES, "phrase string, valence double"))


def test_core_ignores_modifiers(spark, lexicon):
    sentences = spark.createDataFrame([(1, 0, "NOT very good!")], "review_id bigint, sent_pos int, sentence string")
    assert vl.score_sentences(sentences, lexicon, rules=None).first()["compound"] == squeeze(1.9)


def test_model_scorer_sees_512_characters(spark, reviews_of):
    @pandas_udf("label string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        label = texts.str.contains("nice").map({True: "POSITIVE", False: "NEGATIVE"})
        return pd.DataFrame({"label": label, "score": texts.str.len() / 1000})

    reviews = reviews_of((1, "nice " + "x" * 1000), (2, "x" * 600 + " nice"))
    scored = vl.score_texts(reviews, scorer=vl.classifier_scorer(classify))
    assert {r["cafe_id"]: r["compound"] for r in scored.collect()} == {1: 0.512, 2: -0.512}


def test_a_lexicon_or_a_scorer_is_needed(reviews_of):
    with pytest.raises(ValueError):
        vl.score_texts(reviews_of((1, "good")))


def found(df):
    return {(r["review_id"], r["sent_pos"], r["aspect"]) for r in df.collect()}


def test_substring_matches_and_several_aspects(reviews_of):
    reviews = reviews_of((1, "The cloud was nice. Filter COFFEE and cake at a good price."))
    assert found(vl.aspect_mentions(reviews)) == {
        (0, 0, "noise"), (0, 1, "coffee"), (0, 1, "dessert"), (0, 1, "price"),
    }


def test_keyword_table_equals_literal_keywords(spark, reviews_of):
    from venuelens import vocab

    reviews = reviews_of(
        (1, "The cloud was nice. Filter coffee, flat white.\nWi-Fi!"), (2, "Großer KUCHEN. Loud loud loud."), (3, "")
    )
    table = spark.createDataFrame(
        [(a, k) for a, ks in vocab.ASPECT_KEYWORDS.items() for k in ks], "aspect string, keyword string"
    )
    by_table = aspect_mentions_from_table(reviews, table)
    assert found(by_table) == found(vl.aspect_mentions(reviews))
    assert by_table.count() == vl.aspect_mentions(reviews).count()


def test_many_overlapping_keywords_equal_plain_search(spark, reviews_of, monkeypatch):
    """Nested and overlapping keywords of all lengths, in one automaton and in several."""
    from venuelens.operators import aspects

    rng = random.Random(22)
    texts = ["".join(rng.choice("abAB é. ") for _ in range(200)) for _ in range(30)] + ["", "aé" * 5000]
    words = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    table = [(f"A{i % 40}", w) for i, w in enumerate(words)] + [("A1", None), ("A2", ""), (None, "a"), ("A3", "a"), ("A4", "a")]
    keywords = spark.createDataFrame(table, "aspect string, keyword string")
    reviews = reviews_of(*((i, t) for i, t in enumerate(texts))).withColumn("lowered", F.lit("clash")).withColumn("aspect", F.lit(1))
    sentences = vl.sentences(reviews).collect()
    want = {(r.review_id, r.sent_pos, a) for r in sentences for a, w in table if a and w and w in r.sentence.lower()}
    for rows in (aspects.AUTOMATON_ROWS, 20):
        got = aspect_mentions_from_table(reviews, keywords, rows)
        assert found(got) == want and got.count() == len(want)
    none = aspect_mentions_from_table(reviews, keywords.limit(0))
    assert none.count() == 0 and none.columns == got.columns


def test_keywords_that_hold_another_of_their_aspect_give_no_patterns(spark, reviews_of, monkeypatch):
    from venuelens.operators import aspects

    patterns = []
    plain = aspects._automaton_mentions
    monkeypatch.setattr(aspects, "_automaton_mentions", lambda words, place: patterns.extend(words.value) or plain(words, place))
    rows = [("a", "stat"), ("a", "station"), ("b", "station"), ("a", "reinstate"), ("a", "sta" * 90), ("b", "on the"), ("b", "n")]
    keywords = spark.createDataFrame(rows + [("a", f"stat{i}") for i in range(300)], "aspect string, keyword string")
    reviews = reviews_of((1, "The Station. We reinstate stat7! Moon"), (1, "sta" * 91 + "."), (2, "nothing"))
    got = {(r.review_id, r.sent_pos, r.aspect) for r in aspect_mentions_from_table(reviews, keywords).collect()}
    assert got == {(0, 0, "a"), (0, 0, "b"), (0, 1, "a"), (0, 1, "b"), (0, 2, "b"), (1, 0, "a"), (2, 0, "b")}
    assert sorted(p for p in patterns if len(p[0]) < 200) == [("n", ("b",)), ("stat", ("a",))]


def test_large_keys_and_null_venues_survive(spark):
    rows = [(2**60 + 1, None, 1.0, "good coffee here"), (2**60 + 3, 2**61 + 5, 1.0, "cake")]
    reviews = spark.createDataFrame(rows, "review_id bigint, cafe_id bigint, rating double, review_text string")
    keywords = spark.createDataFrame([("drink", "COFFEE"), ("food", "ake")], "aspect string, keyword string")
    got = {(r.cafe_id, r.review_id, r.aspect) for r in aspect_mentions_from_table(reviews, keywords).collect()}
    assert got == {(None, 2**60 + 1, "drink"), (2**61 + 5, 2**60 + 3, "food")}


def test_time_follows_the_text_not_the_keywords(spark, reviews_of):
    """50,000 keywords cost hardly more than 50: each sentence is read once."""
    rng = random.Random(23)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(20_000))
    reviews = reviews_of(*((i, text) for i in range(4))).cache()
    seconds = {}
    for n in (50, 50_000):
        rows = [(f"a{i % 9}", "".join(rng.choice("abcdefgh") for _ in range(5 + i % 9))) for i in range(n)]
        table = spark.createDataFrame(rows, "aspect string, keyword string")
        aspect_mentions_from_table(reviews, table).count()
        began = time.perf_counter()
        aspect_mentions_from_table(reviews, table).count()
        seconds[n] = time.perf_counter() - began
    reviews.unpersist()
    assert seconds[50_000] < 20 * seconds[50] + 10


def test_two_level_mean(spark, reviews_of):
    def scorer(df):
        value = F.regexp_extract("sentence", r"(\d\.\d)", 1).cast("double")
        return df.withColumn("compound", value)

    reviews = reviews_of((1, "coffee 1.0! coffee 0.0! coffee 0.0!"), (1, "coffee 1.0!"))
    per_review = vl.aspect_by_review(reviews, scorer=scorer)
    assert per_review.count() == 2
    row = vl.aspect_by_venue(per_review).first()
    assert row["compound"] == pytest.approx(2 / 3) and row["score"] == 8.3 and row["n_reviews"] == 2


def test_more_aspects_than_bits_in_a_number(reviews_of, lexicon):
    aspects = {f"a{i}": [f"w{i:03d}"] for i in range(130)}
    text = " ".join(f"w{i:03d}" for i in (0, 61, 62, 63, 129)) + " good."
    rows = vl.aspect_by_review(reviews_of((1, text)), lexicon, aspects).collect()
    assert {r["aspect"] for r in rows} == {"a0", "a61", "a62", "a63", "a129"}


def test_map_and_rows(spark, reviews_of, lexicon):
    per_venue = vl.aspect_by_venue(vl.aspect_by_review(reviews_of((1, "good coffee. bad cake.")), lexicon))
    as_map = vl.aspect_map(per_venue)
    assert set(as_map.first()["aspect_sentiment_10"]) == {"coffee", "dessert"}
    assert {tuple(r) for r in vl.aspect_rows(as_map).collect()} == {
        (r["cafe_id"], r["aspect"], r["score"]) for r in per_venue.collect()
    }


def test_independent_of_partitioning(reviews_of, lexicon):
    rows = [(i % 3, f"coffee is {'very ' * (i % 4)}good. cake not bad number {i}!") for i in range(60)]
    one = vl.aspect_by_venue(vl.aspect_by_review(reviews_of(*rows).repartition(1), lexicon))
    many = vl.aspect_by_venue(vl.aspect_by_review(reviews_of(*rows).repartition(7), lexicon))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_one_exchange_per_review_and_no_python(spark, tmp_path, lexicon, reviews_of):
    path = str(tmp_path / "reviews")
    reviews_of((1, "good coffee.")).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(vl.aspect_by_review(spark.read.parquet(path), lexicon))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the token, its three predecessors, and the word after "no"
    assert plan.count("BroadcastHashJoin") == 5
    exchanges = re.findall(r"(?<!Broadcast)Exchange\n[^\n]*\n(?:[^\n]+\n)*", plan) + re.findall(r"(?<!Broadcast)Exchange hash[^\n]*", plan)
    assert exchanges and not any("sentence#" in e or "review_text" in e for e in exchanges)
    assert "EvalPython" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_scorer_sees_text_beyond_its_window(spark):
    def classify(text):
        hit = F.contains(text, F.lit("decisive"))
        return F.struct(F.when(hit, "NEGATIVE").otherwise("POSITIVE").alias("label"), F.when(hit, 0.9).otherwise(0.5).alias("score"))

    rows = [(1, 0, "plain " * 200 + "decisive"), (2, 0, "short"), (3, 0, None)]
    frame = spark.createDataFrame(rows, "review_id bigint, sent_pos int, sentence string")
    got = {r.review_id: r.compound for r in vl.score_sentences(frame, scorer=vl.classifier_scorer(classify)).collect()}
    assert got == {1: -0.9, 2: 0.5, 3: 0.5}


def test_only_sentiment_words_meet_the_cues(spark, reviews_of):
    """The valence is asked for before the joins that look back; a sentence without a known word still has its row."""
    reviews = reviews_of((1, "Not a very GOOD place but nice! Nothing known here. no good"), (1, " \x1c  "), (2, None))
    lexicon = spark.createDataFrame([("good", 1.9), ("nice", 1.8)], "token string, valence double")
    scored = vl.score_sentences(vl.sentences(reviews), lexicon)
    plan = plan_of(scored)
    asked = plan.index("Filter (isnotnull(valence")
    assert plan.rindex("BroadcastHashJoin [cue1") < asked < plan.rindex("BroadcastHashJoin [token")
    assert [(r.review_id, r.sent_pos) for r in scored.orderBy("review_id", "sent_pos").collect()] == [(0, 0), (0, 1), (0, 2)]
    assert scored.where("sent_pos = 1").first().compound == 0.0


def test_texts_are_trimmed_of_all_whitespace_at_their_ends_only(spark):
    from venuelens.functions import text as X

    ends = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    rows = [(ends + "a" + ends + "​é" + ends[::-1], "a" + ends + "​é"), (ends, ""), ("᠎x﻿", "᠎x﻿"), (None, "")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", X.strip(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect()) and "regexp_replace" not in plan_of(df)
