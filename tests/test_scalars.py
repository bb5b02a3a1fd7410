import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import venuelens as vl
from venuelens import vocab
from venuelens.functions import text as X
from venuelens.functions.rounding import exact_round, scaled_round
from venuelens.functions.scores import get_or, omit_missing, score_to_ten


def values(df, col="v"):
    return [r[0] for r in df.select(col).collect()]


def test_exact_round_equals_python_round(spark):
    rng = random.Random(1)
    xs = [0.125, 0.375, 2.675, 1.005, 8.25, 8.35, 0.5, 1.5, -2.5, -0.125, 1e-9, 12345.675]
    xs += [rng.uniform(-10, 10) for _ in range(2000)]
    xs += [i / 200 for i in range(2001)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 2, 4):
        got = values(df.select(exact_round(F.col("x"), digits).alias("v")))
        assert got == [round(x, digits) for x in xs]


def test_scaled_round_equals_array_rounding(spark):
    xs = [i / 8 for i in range(-80, 81)] + [i / 200 for i in range(2001)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = values(df.select(scaled_round(F.col("x"), 2).alias("v")))
    assert got == list(np.round(np.array(xs), 2))


def test_flags(spark):
    df = spark.createDataFrame([("True",), ("FALSE",), ("nan",), (None,), ("yes",)], "f string")
    assert values(vl.parse_flags(df, ["f"]), "f") == [True, False, None, None, None]


@pytest.mark.parametrize(
    "written, amount, label",
    [
        ("-500", 500, "Under 700"),
        ("1.5k", 15, "Under 700"),
        ("", 700, "Under 700"),
        (None, 700, "Under 700"),
        ("no idea", 700, "Under 700"),
        ("700", 700, "Under 700"),
        ("701", 701, "700 to 2000"),
        ("Rs 2,000", 2000, "700 to 2000"),
        ("2001", 2001, "Above 2000"),
        ("9" * 40, None, "Above 2000"),
    ],
)
def test_budget_text(spark, written, amount, label):
    df = spark.createDataFrame([(written,)], "t string")
    parsed = vl.parse_budget_amount(F.col("t"))
    assert tuple(df.select(parsed, vl.budget_bucket(parsed)).first()) == (amount, label)


def test_budget_label_and_tags(spark):
    df = spark.createDataFrame(
        [("₹", "Study|Work"), ("₹₹₹", "Friends, Solo"), ("n/a", None)], "budget string, purpose_tags string"
    )
    out = vl.normalize_tags(vl.with_budget_label(df)).withColumn("t", vl.tags_array(F.col("purpose_tags")))
    assert [tuple(r) for r in out.select("budget_label", "purpose_tags", "t").collect()] == [
        ("Under 700", "Study,Work", ["Study", "Work"]),
        ("Above 2000", "Friends, Solo", ["Friends", "Solo"]),
        (None, None, None),
    ]
    own = df.withColumn("budget_label", F.lit("mine"))
    assert set(values(vl.with_budget_label(own), "budget_label")) == {"mine"}


def test_score_conversions(spark):
    df = spark.createDataFrame([(2 / 3,), (0.65,), (-1.0,), (1.0,)], "c double")
    assert values(df.select(score_to_ten(F.col("c")).alias("v"))) == [
        round((c + 1) / 2 * 10, 1) for c in (2 / 3, 0.65, -1.0, 1.0)
    ]
    one = spark.range(1)
    signed = [
        vl.signed_score(F.lit("POSITIVE"), F.lit(0.9)),
        vl.signed_score(F.lit("NEGATIVE"), F.lit(0.8)),
    ]
    assert tuple(one.select(*signed).first()) == (0.9, -0.8)
    m = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(None).cast("double"))
    row = one.select(get_or(m, "a", 9.0), get_or(m, "b", 9.0), get_or(m, "c", 9.0), F.size(omit_missing(m)))
    assert tuple(row.first()) == (1.0, 9.0, 9.0, 1)


SPLITS = {
    "Hi there!  Ok?Yes. no way.": ["Hi there!", "Ok?Yes.", "no way."],
    "  padded.\n\nNext one\t": ["padded.", "Next one"],
    "a. b!  c?\x1cd": ["a.", "b!", "c?", "d"],
    " ": [],
    "": [],
    "no end": ["no end"],
    "3.5 stars... Really.": ["3.5 stars...", "Really."],
}


def test_sentence_split(spark):
    df = spark.createDataFrame([(t,) for t in SPLITS], "t string")
    got = values(df.select(X.sentence_array(F.col("t")).alias("v")))
    assert got == list(SPLITS.values())
    assert values(spark.sql("select cast(null as string) t").select(X.sentence_array(F.col("t")).alias("v"))) == [[]]


def test_words(spark):
    df = spark.createDataFrame([("Don't STOP café-bar x2",)], "t string")
    assert values(df.select(X.word_array(F.col("t")).alias("v"))) == [["don't", "stop", "caf", "bar", "x"]]


@pytest.mark.parametrize(
    "token, bare",
    [
        ("(great)", "great"), ('"ok"', '"ok"'), ("...", "..."), (":)", ":)"), ("don't!!", "don't"),
        ("a-b,", "a-b"), ("--x--", "--x--"), ("[wow]...", "wow"), ("été,", "été"), ("plain", "plain"),
    ],
)
def test_bare_tokens(spark, token, bare):
    df = spark.createDataFrame([(f"{token} {token}",)], "t string")
    cleaned = X.spaced_tokens(X.without_outer_punctuation(F.col("t")))
    assert values(df.select(cleaned.alias("v"))) == [[bare, bare]]


def test_token_and_text_checks(spark):
    sentences = ["one", "a b c", "a b c d", "a\u00a0b\tc\x1cd e", "x"]
    df = spark.createDataFrame([(s,) for s in sentences], "t string")
    counts = values(df.select(X.spaced_token_count(F.col("t")).alias("v")))
    assert counts == [1, 3, 4, 5, 1]
    for n in (1, 2, 4, 5):
        assert values(df.select(X.has_tokens(F.col("t"), n).alias("v"))) == [c >= n for c in counts]
    texts = spark.createDataFrame([(" a",), ("\u00a0 \x1c\n",), ("",), (None,)], "t string")
    assert values(texts.select(X.has_text(F.col("t")).alias("v"))) == [True, False, False, False]


def test_position_orders_like_the_pair(spark):
    pairs = [(0, 5), (1, 0), (3, 2**31 - 1), (4, 0), (2**62, 7), (2**62, 8)]
    df = spark.createDataFrame(pairs, "r bigint, o int").withColumn("p", X.position(F.col("r"), F.col("o")))
    rows = df.orderBy("p").select(X.position_review(F.col("p")), X.position_offset(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == pairs


def test_cosine(spark):
    df = spark.sql("select array(1.0D, 0.0D) a, array(1.0D, 1.0D) b, array(0.0D, 0.0D) z")
    row = df.select(vl.cosine(F.col("a"), F.col("b")), vl.cosine(F.col("a"), F.col("z"))).first()
    assert math.isclose(row[0], math.sqrt(0.5)) and row[1] is None


def test_vocabularies():
    assert len(vocab.ATMOSPHERES) + len(vocab.PURPOSES) + len(vocab.SCORE_COLS) + 1 == 18
    assert math.isclose(sum(vocab.COMPOSITE_WEIGHTS.values()), 1.0)
    assert set(vocab.BUDGET_MAP) == set(vocab.BUDGET_LABELS)
