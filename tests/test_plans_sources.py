import json

import pytest
from pyspark.sql import functions as F

import venuelens as vl
from venuelens import schemas, vocab
from venuelens.operators.composite import composite
from venuelens.plans.analysis import ANALYSIS_COLS
from venuelens.session import shared_folder, spread

ROWS = [
    # id, name, budget, tags, flags, scores, overall
    (2, "Blue, \"Door\"", "₹", "Study|Work", "True", 9.0, 4.5),
    (1, "Attic", "₹₹", "Date", "FALSE", 6.5, 4.0),
    (3, "Attic", "₹", "Friends, Solo", "nan", 7.0, 3.0),
    (4, "Cellar", "?", "Brunch", "", 7.0, 2.0),
]
TEXTS = [
    (1, 5.0, 'He said "good coffee here". It was\na great evening for all.'),
    (1, 4.5, "The coffee was bad. Crowded but good value overall."),
    (2, None, "Good. Nice."),
    (9, 1.0, "Orphan review about coffee here."),
    (3, 3.0, "back\\slash, comma and good cake today."),
]


def raw_rows():
    for i, name, budget, tags, flag, score, rating in ROWS:
        yield {
            "cafe_id": i, "name": name, "area": "North", "location": "Town", "budget": budget,
            "atmosphere": "Minimal", "purpose_tags": tags, "noise_level": "Low",
            **{f: flag for f in vocab.FLAG_COLS}, **{c: score for c in vocab.SCORE_COLS},
            "overall_rating": rating,
        }


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """CSV files as a spreadsheet tool writes them; columns in an order of their own."""
    import pandas as pd

    folder = tmp_path_factory.mktemp("csv")
    venues = pd.DataFrame(list(raw_rows()))
    venues.insert(0, "extra", "x")
    venues[sorted(venues.columns)].to_csv(folder / "venues.csv", index=False)
    reviews = pd.DataFrame(TEXTS, columns=["cafe_id", "rating", "review_text"])
    reviews.to_csv(folder / "reviews.csv", index=False)
    return str(folder / "venues.csv"), str(folder / "reviews.csv")


@pytest.fixture(scope="module")
def tables(spark, files):
    return vl.load(spark, *files)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("great", 3.1)], schemas.LEXICON)


@pytest.fixture(scope="module")
def analysis(tables, lexicon):
    return vl.analyze(*tables, lexicon).cache()


def test_csv_survives_quotes_breaks_and_column_order(tables):
    venues, reviews = tables
    first = venues.filter("cafe_id = 2").first()
    assert first["name"] == 'Blue, "Door"' and first["open_now"] is True
    assert first["budget_label"] == "Under 700" and first["purpose_tags"] == "Study,Work"
    got = [(r["cafe_id"], r["rating"], r["review_text"]) for r in reviews.orderBy("review_id").collect()]
    assert got == TEXTS


def test_parquet_and_json_sources(spark, files, tmp_path):
    reviews = vl.read_reviews(spark, files[1])
    vl.to_parquet(reviews, str(tmp_path / "r"))
    reviews.write.json(str(tmp_path / "j"))
    want = sorted(map(tuple, reviews.collect()), key=repr)
    for path, fmt in (("r", "parquet"), ("j", "json")):
        again = vl.read_reviews(spark, str(tmp_path / path), fmt)
        assert sorted(map(tuple, again.collect()), key=repr) == want


def test_prefs_source(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"user_id": 1, "budget_text": "900", "coffee": 1}\n')
    prefs = vl.read_prefs(spark, str(tmp_path / "p.json"))
    assert vl.encode_prefs(prefs).first()["features"][-1] == 2 / 3


def test_a_missing_column_is_named(spark, tmp_path):
    (tmp_path / "v.csv").write_text("cafe_id,name\n1,a\n")
    with pytest.raises(ValueError, match="coffee_score"):
        vl.read_venues(spark, str(tmp_path / "v.csv"))


def test_composite_is_the_python_sum(tables):
    weights = vocab.COMPOSITE_WEIGHTS
    for r in tables[0].withColumn("c", composite()).collect():
        total = 0
        for name, w in weights.items():
            total += float(r[name]) * w
        assert r["c"] == round(total, 2)


def test_analysis_record(analysis):
    assert analysis.columns == ANALYSIS_COLS
    rows = {r["cafe_id"]: r for r in analysis.collect()}
    assert set(rows) == {1, 2, 3, 4}
    one = rows[1]
    assert one["num_reviews"] == 2 and one["avg_review_rating"] == 4.75
    assert set(one["aspect_sentiment_10"]) == {"coffee", "noise", "price"}
    assert one["keywords"][:2] == ["good", "coffee"]
    assert "coffee" in one["ai_summary"]
    assert rows[2]["ai_summary"] == "" and rows[2]["avg_review_rating"] is None
    none = rows[4]
    assert (none["num_reviews"], none["avg_review_rating"]) == (0, None)
    assert none["ai_summary"] == vocab.NO_REVIEWS_SUMMARY
    assert none["keywords"] == [] and none["aspect_sentiment_10"] == {}


def test_written_counts_change_nothing(spark, tables, lexicon, analysis):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    again = vl.analyze(*tables, lexicon, write_counts=True)
    key = lambda r: r["cafe_id"]
    assert sorted(again.collect(), key=key) == sorted(analysis.collect(), key=key)


def test_json_records(analysis, tmp_path):
    records = [json.loads(r["json"]) for r in vl.analysis_to_json(analysis).collect()]
    assert {tuple(r) for r in records} == {tuple(ANALYSIS_COLS)}
    vl.write_analysis_json(analysis, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["cafe_id"]) == sorted(records, key=lambda r: r["cafe_id"])


def test_kpis_and_boards(tables, analysis):
    enriched = vl.enrich(tables[0], analysis)
    kpis = vl.dashboard_kpis(enriched).first()
    assert (kpis["total_venues"], kpis["total_reviews"]) == (4, 4)
    assert kpis["avg_overall_rating_shown"] == 3.4
    assert [r["cafe_id"] for r in vl.board(enriched, "trending").collect()] == [2, 3, 4, 1]
    assert [r["cafe_id"] for r in vl.board(enriched, "budget").collect()] == [2, 3]
    assert "TakeOrderedAndProject" in vl.board(enriched, "study")._jdf.queryExecution().executedPlan().toString()


def test_card(spark, tables, analysis):
    matches = vl.recommend_enriched(
        tables[0], spark.createDataFrame([(1, "Minimal", "Study")], "user_id bigint, atmosphere string, purpose string"), analysis, k=2
    )
    card = vl.venue_card(matches).orderBy("rank").first()
    assert card["caption"] == "North, Town · ₹ · Minimal atmosphere · Noise: Low"
    assert card["tags"] == "Study, Work · Under 700"
    assert card["show_coffee"] == "9.0/10" and card["ai_score"] == "9.0/10"
    assert card["match"].endswith("%") and card["rating"] == "N/A" and card["reviews"] == 1


def test_form(spark, tables, analysis):
    prefs = spark.createDataFrame([(1, "Rs 300"), (2, "5000")], "user_id bigint, budget_text string")
    out = vl.submit_form(tables[0], prefs, analysis, outdoor=True, quiet=True)
    assert [(r["user_id"], r["cafe_id"]) for r in out.collect()] == [(1, 2)]
    assert [tuple(r) for r in vl.match_counts(out).collect()] == [(1, 1)]
    everyone = prefs.select("user_id").union(prefs.select(F.lit(77).cast("bigint")))
    assert sorted(map(tuple, vl.match_counts(out, everyone).collect()))[-1] == (77, 0)


def test_report_takes_the_first_of_equal_names(tables, analysis):
    report = vl.venue_report(*[tables[0], analysis, tables[1]], "Attic")
    assert [r["cafe_id"] for r in report.header.collect()] == [1]
    assert report.scores.count() == 6
    assert {r["aspect"] for r in report.aspects.collect()} == {"coffee", "noise", "price"}
    assert sorted(r["stars"] for r in report.reviews.collect()) == [4, 5]


def test_duplicate_keys(tables):
    venues, _ = tables
    assert vl.duplicate_keys(venues, "cafe_id").count() == 0
    assert vl.duplicate_keys(venues, "name").first()["name"] == "Attic"


def test_spread_only_when_tasks_are_few(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    many = spark.range(10).repartition(6)
    assert spread(many) is many


def test_filters_reach_the_scan(spark, tmp_path, tables):
    tables[1].write.parquet(str(tmp_path / "r"))
    plan = vl.reviews_of(spark.read.parquet(str(tmp_path / "r")), 1).select("rating")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cafe_id), EqualTo(cafe_id,1)" in text or "In(cafe_id" in text
    assert "review_text" not in text.split("ReadSchema")[1]


def test_nothing_is_lost_silently_at_the_sources(spark, tmp_path):
    typed = "cafe_id,review_id,rating,review_text\nC001,R1,4.5,good\nC002,R2,,bad\n"
    (tmp_path / "r.csv").write_text(typed)
    with pytest.raises(Exception, match="is no bigint: [CR]"):
        vl.read_reviews(spark, str(tmp_path / "r.csv")).collect()
    rows = vl.read_reviews(spark, str(tmp_path / "r.csv"), schema=schemas.text_keys(schemas.REVIEWS)).collect()
    assert sorted((r.cafe_id, r.review_id, r.rating) for r in rows) == [("C001", "R1", 4.5), ("C002", "R2", None)]
    spark.createDataFrame([("C1", "R1", 4.0, "x")], "cafe_id string, review_id string, rating double, review_text string").write.parquet(
        str(tmp_path / "r")
    )
    assert vl.read_reviews(spark, str(tmp_path / "r"), "parquet").first()["cafe_id"] == "C1"
    (tmp_path / "r.json").write_text('{"cafe_id": 1, "review_id": 2, "rating": "four", "review_text": "x"}\n')
    with pytest.raises(Exception, match="rating is no double: four"):
        vl.read_reviews(spark, str(tmp_path / "r.json"), "json").collect()


def test_numbers_of_reviews_do_not_change(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("cafe_id,rating,review_text\n" + "".join(f"{j},4,text {i} {j}\n" for j in range(5)))
    reviews = vl.read_reviews(spark, str(tmp_path))
    first = {r.review_text: r.review_id for r in reviews.collect()}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert {r.review_text: r.review_id for r in reviews.repartition(5).collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(set(first.values())) == 15
