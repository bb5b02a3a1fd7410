import math
import random

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import venuelens as vl
from venuelens import vocab
from venuelens.operators import recommend as R
from venuelens.operators.search_tree import build_tree, search_tree

VENUE = (
    "cafe_id bigint, budget string, atmosphere string, purpose_tags string, noise_level string, "
    "outdoor_seating boolean, " + ", ".join(f"{c} double" for c in vocab.SCORE_COLS)
)
PREF = "user_id bigint, atmosphere string, purpose string, budget string, " + ", ".join(
    f"{c} double" for c in vocab.PRIORITIES
)


def make_venues(rng, n, copies=0):
    """``copies`` of the rows carry the very same features."""
    rows = []
    for i in range(n):
        if i < copies:
            rest = ["₹", "Minimal", "Study|Work", "Low", True] + [8.0] * 6
        else:
            rest = [
                rng.choice(["₹", "₹₹", "₹₹₹", "n/a"]),
                rng.choice([*vocab.ATMOSPHERES, "Garden"]),
                rng.choice(["Study|Work", "Date", "Friends, Solo", "Solo,Study|Solo", "Brunch", None]),
                rng.choice(["Low", "High"]),
                rng.choice([True, False, None]),
                *[round(rng.uniform(0, 10), 1) for _ in range(6)],
            ]
        rows.append((i * 3 % (n * 3 + 1), *rest))
    return rows


def make_prefs(rng, n):
    rows = []
    for i in range(n):
        rows.append(
            (
                i,
                rng.choice([*vocab.ATMOSPHERES, "", None]),
                rng.choice([*vocab.PURPOSES, "", None]),
                rng.choice([*vocab.BUDGET_LABELS, None]),
                *[rng.choice([None, round(rng.random(), 2), 0.0, 1.0]) for _ in range(6)],
            )
        )
    return rows


def brute(venues, prefs, k, keep=lambda venue, pref: True):
    """Every pair, by the 18-place vectors."""
    labels = vocab.BUDGET_SYMBOLS
    out = {}
    for p in prefs:
        weights = [d if w is None else w for w, d in zip(p[4:], vocab.PRIORITY_DEFAULTS.values())]
        label = p[3] or "700 to 2000"
        u = [float(p[1] == a) for a in vocab.ATMOSPHERES] + [float(p[2] == x) for x in vocab.PURPOSES]
        u += weights + [vocab.BUDGET_MAP[label] / 3]
        scored = []
        for v in venues:
            if None in v[6:] or not keep(v, p[3]):
                continue
            tags = [t.strip() for t in (v[3] or "").replace("|", ",").split(",")]
            x = [float(v[2] == a) for a in vocab.ATMOSPHERES] + [float(t in tags) for t in vocab.PURPOSES]
            x += [s / 10 for s in v[6:]] + [vocab.BUDGET_MAP.get(labels.get(v[1]), 2) / 3]
            sim = sum(a * b for a, b in zip(u, x)) / math.sqrt(sum(a * a for a in u) * sum(b * b for b in x))
            scored.append((-sim, v[0]))
        out[p[0]] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


def same(got_df, want):
    got = {}
    for r in got_df.orderBy("user_id", F.desc("similarity"), "cafe_id").collect():
        got.setdefault(r["user_id"], []).append(r)
    assert set(got) == {u for u, best in want.items() if best}
    for user, best in want.items():
        rows = got.get(user, [])
        assert len(rows) == len(best)
        for r, (_, sim) in zip(rows, best):
            assert r["similarity"] == pytest.approx(sim, abs=1e-12)
            assert r["match_score"] == pytest.approx(sim * 100, abs=0.0501)
        # equal similarity up to rounding may swap ids; otherwise they must agree
        for i, (cafe, sim) in enumerate(best):
            if all(abs(sim - s) > 1e-12 for j, (_, s) in enumerate(best) if j != i) and i < len(best) - 1:
                assert rows[i]["cafe_id"] == cafe
        assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("copies", [0, 150])
@pytest.mark.parametrize("widths", [None, (10.0,), (5.0, 2.0)])
def test_against_every_pair(spark, copies, widths):
    rng = random.Random(11)
    venues, prefs = make_venues(rng, 450, copies), make_prefs(rng, 40)
    got = vl.recommend(spark.createDataFrame(venues, VENUE), spark.createDataFrame(prefs, PREF), widths=widths)
    same(got, brute(venues, prefs, 5))


def test_own_budget_only(spark):
    rng = random.Random(12)
    venues, prefs = make_venues(rng, 200, 70), make_prefs(rng, 30)
    got = vl.recommend(
        spark.createDataFrame(venues, VENUE), spark.createDataFrame(prefs, PREF), k=4, match_budget=True
    )
    same(got, brute(venues, prefs, 4, lambda v, label: label in (None, "", "Any") or vocab.BUDGET_SYMBOLS.get(v[1]) == label))


def test_one_budget_for_all_and_any(spark):
    rng = random.Random(13)
    venues, prefs = make_venues(rng, 120), make_prefs(rng, 10)
    v, p = spark.createDataFrame(venues, VENUE), spark.createDataFrame(prefs, PREF)
    same(
        vl.recommend(v, p, budget_label="Above 2000"),
        brute(venues, prefs, 5, lambda row, _: row[1] == "₹₹₹"),
    )
    same(vl.recommend(v, p, budget_label="Any"), brute(venues, prefs, 5))


def test_copies_are_ranked_by_id(spark):
    venues = make_venues(random.Random(1), 60, 60)
    prefs = spark.createDataFrame(make_prefs(random.Random(2), 3), PREF)
    rows = vl.recommend(spark.createDataFrame(venues, VENUE), prefs, k=4).collect()
    ids = sorted(v[0] for v in venues)[:4]
    for user in range(3):
        assert [r["cafe_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["user_id"] == user] == ids


def test_knn_gives_the_same_ranking(spark):
    rng = random.Random(14)
    v = spark.createDataFrame(make_venues(rng, 150), VENUE)
    p = spark.createDataFrame(make_prefs(rng, 15), PREF)
    cosine = {(r["user_id"], r["rank"]): r for r in vl.recommend(v, p).collect()}
    for r in vl.recommend(v, p, method="knn").collect():
        twin = cosine[r["user_id"], r["rank"]]
        assert r["match_score"] == twin["match_score"]
        assert r["distance"] == pytest.approx(1 - twin["similarity"])


def test_fewer_venues_than_k_and_none(spark):
    rng = random.Random(15)
    v, p = spark.createDataFrame(make_venues(rng, 3), VENUE), spark.createDataFrame(make_prefs(rng, 4), PREF)
    assert vl.recommend(v, p).count() == 12
    empty = vl.recommend(v.limit(0), p)
    assert empty.count() == 0 and "match_score" in empty.columns


def test_venues_with_a_missing_score_are_not_ranked(spark):
    rng = random.Random(16)
    v = spark.createDataFrame(make_venues(rng, 30), VENUE).withColumn(
        "date_score", F.when(F.col("cafe_id") % 2 == 0, F.col("date_score"))
    )
    p = spark.createDataFrame(make_prefs(rng, 3), PREF)
    assert all(r["cafe_id"] % 2 == 0 for r in vl.recommend(v, p, k=50).collect())


def test_defaults_and_priorities_struct(spark):
    flat = spark.createDataFrame([(1, "Minimal", "Study", 1.0)], "user_id bigint, atmosphere string, purpose string, coffee double")
    nested = flat.select("user_id", "atmosphere", "purpose", F.struct("coffee").alias("priorities"))
    features = [vl.encode_prefs(p).first()["features"] for p in (flat, nested)]
    assert features[0] == features[1]
    assert features[0] == [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1.0, 0.6, 0.5, 0.5, 0.5, 0.5, 2 / 3]


def test_facets(spark):
    venues = make_venues(random.Random(17), 60)
    v = spark.createDataFrame(venues, VENUE)
    got = {r[0] for r in vl.facet_filter(v, outdoor=True, quiet=True, atmosphere=None).select("cafe_id").collect()}
    assert got == {r[0] for r in venues if r[5] is True and r[4] == "Low"}
    assert vl.facet_filter(v).count() == 60


def test_plan_meets_no_venue_without_a_key(spark):
    rng = random.Random(18)
    v = spark.createDataFrame(make_venues(rng, 30), VENUE)
    p = spark.createDataFrame(make_prefs(rng, 3), PREF)
    stored = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], "vec_id bigint, embedding array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "query_id bigint, query array<double>")
    for df in (vl.recommend(v, p, match_budget=True), vl.recommend(v, p), vl.nearest(stored, asked, 2)):
        plan = plan_of(df)
        assert "WindowGroupLimit" in plan
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "EvalPython" not in plan


def test_number_of_blocks_is_bounded(spark, monkeypatch):
    """The coarsest width fits whatever the data; finer ones are counted."""
    assert R.block_bound(R.WIDTHS[-1]) <= R.MAX_BLOCKS < R.block_bound(R.WIDTHS[0])
    rng = random.Random(20)
    venues, prefs = make_venues(rng, 400), make_prefs(rng, 12)
    v, p = spark.createDataFrame(venues, VENUE), spark.createDataFrame(prefs, PREF)
    vectors = R.distinct_venue_vectors(v, 5)
    assert R._first_width(vectors, None) == (0.5,)
    monkeypatch.setattr(R, "MAX_BLOCKS", 330)
    assert R._first_width(vectors, None)[0] > 0.5
    with pytest.raises(ValueError):
        vl.recommend(v, p, widths=(0.5,))
    monkeypatch.setattr(R, "CROWDED", 0)
    assert len(R._first_width(vectors, None)) == 2
    same(vl.recommend(v, p), brute(venues, prefs, 5))


def test_tree_holds_the_best_and_opens_few_nodes():
    """Against the largest bound of every block; users open a small share of the bounds."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(200, 10))
    low = centres[rng.integers(0, 200, 30_000)] + rng.normal(scale=0.1, size=(30_000, 10))
    high = low + rng.uniform(0, 0.02, low.shape)
    count, marks = rng.integers(1, 4, len(low)), rng.integers(0, 16, len(low))
    users = rng.normal(size=(60, 10))
    asked = np.where(np.arange(60) % 3 == 0, 5, 0)
    tree = build_tree(low, high, count, marks)
    who, block, limit, looked = search_tree(tree, users, asked, 5)
    assert looked < 0.05 * len(users) * len(low)
    for u in range(60):
        fits = (marks & asked[u]) == asked[u]
        lower = np.where(users[u] >= 0, users[u] * low, users[u] * high).sum(axis=1)
        upper = np.where(users[u] >= 0, users[u] * high, users[u] * low).sum(axis=1)
        order = [i for i in np.argsort(-lower) if fits[i]]
        kth = lower[order[int(np.searchsorted(np.cumsum(count[order]), 5))]]
        mine = set(block[who == u].tolist())
        assert limit[u] <= kth + 1e-12 and mine >= set(np.flatnonzero(fits & (upper >= kth)).tolist())
        assert all(fits[i] for i in mine)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_tree_of_few_blocks(n):
    low = np.arange(2.0 * n).reshape(n, 2)
    tree = build_tree(low, low + 1, np.ones(n, int), np.zeros(n, int))
    who, block, limit, _ = search_tree(tree, np.array([[1.0, -0.5], [0.0, 0.0]]), np.array([0, 0]), n + 1)
    assert sorted(zip(who.tolist(), block.tolist(), strict=True)) == [(u, b) for u in (0, 1) for b in range(n)]
    assert (limit == -np.inf).all()
    who, *_ = search_tree(tree, np.ones((1, 2)), np.array([4]), 1)
    assert not len(who)


@pytest.mark.parametrize("grouped", [True, False])
def test_nearest_against_every_pair(spark, grouped):
    rng = random.Random(19)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    stored = []
    for i in range(300):
        c = 0 if i % 3 == 0 else rng.randrange(6)
        spread = 0.1 if grouped else 3.0
        stored.append((i, [x + rng.gauss(0, spread) for x in centres[c]], c))
    stored += [(900, [0.0] * 8, 1), (901, stored[0][1], 0)]
    queries = [(q, [rng.gauss(0, 1) for _ in range(8)]) for q in range(12)] + [(99, stored[0][1])]
    got = vl.nearest(
        spark.createDataFrame(stored, "vec_id bigint, embedding array<float>, label int"),
        spark.createDataFrame(queries, "query_id bigint, query array<double>"),
        7,
    ).collect()

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for q, vec in queries:
        best = sorted((-cos(vec, v), i) for i, v, _ in stored if any(v))[:7]
        rows = sorted((r["rank"], r["similarity"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in rows] == list(range(1, 8))
        assert [r[1] for r in rows] == pytest.approx([-s for s, _ in best], abs=1e-6)
