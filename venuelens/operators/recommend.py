"""Exact top-k venues per user by cosine similarity, without meeting every pair.

Scoring every user against every venue grows with the product of both tables.  Three
exact reductions keep it away from that:

1. Venues with equal features get equal similarity for everybody, so of each set of
   copies only the ``k`` smallest ids can ever be chosen.  Users with equal preferences
   get equal matches, so each distinct set of preferences is ranked once.
2. Venues are grouped into blocks: budget label, known atmosphere, set of known purposes,
   facets and score bins, the bins as fine as at most ``MAX_BLOCKS`` blocks allow.  The range of
   each component of the normalised vectors in a block bounds its similarity to any user from both sides.
3. The blocks are the leaves of a tree of such bounds (``search_tree``), which is broadcast.  A
   user opens only the nodes that may still hold one of the best ``k``; the blocks that are left
   are joined with their venues, by an equi-join on the block.  Where blocks hold many vectors, a
   finer level of blocks narrows them once more, joined by shuffle.

Users who ask for a label of the caller's own meet only the blocks with that label, by a join.

Nothing is dropped that could be chosen, whatever the data: where the bounds are loose,
more pairs are scored.
"""

from __future__ import annotations

import sys
from functools import reduce
from math import ceil
from operator import add

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens import vocab
from venuelens.functions.clean import budget_fraction, tag_list, with_budget_label
from venuelens.functions.scores import distance_to_similarity, percent, unit_score
from venuelens.operators.features import complete_prefs
from venuelens.operators.filters import budget_filter as keep_label
from venuelens.operators.filters import facet_condition
from venuelens.operators.search_tree import MARGIN, build_tree, search_tree
from venuelens.session import broadcast_if_small, task_count, written

# Functions for tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_SCORE = 10.0
#: Blocks of the first level, at most; their summaries are collected for the tree (some 200 bytes each).
MAX_BLOCKS = 32_768
#: Widths of the score bins that are tried for the first level, finest first; with the last one there
#: are at most ``block_bound(10.0)`` blocks, whatever the data.
WIDTHS = (0.5, 1.0, 2.0, 5.0, 10.0)
#: Vectors in a block, on average, from which a finer level is added.
CROWDED = 64

_N_ATMOSPHERES, _N_PURPOSES = len(vocab.ATMOSPHERES), len(vocab.PURPOSES)
_SCORES = [f"s{i}" for i in range(len(vocab.SCORE_COLS))]
_WEIGHTS = [f"p{i}" for i in range(len(vocab.PRIORITIES))]
_SHAPE = ["u_atmosphere", "u_purpose", *_WEIGHTS, "u_budget", "u_norm", "scope", "need"]
_USER = ["u_key", *_SHAPE]
#: The scope of users who ask for no label of their own.
_ANY_SCOPE = ""
#: Columns with the users' own check boxes (``wifi`` alone is a priority), and what they ask for.
FACETS = {"want_outdoor": "outdoor", "want_quiet": "quiet", "want_wifi": "wifi"}


def _index(col: Column, values: list[str], absent: int = 0) -> Column:
    """1-based place in ``values``; ``absent`` for anything else."""
    out = F.lit(absent)
    for i, v in reversed(list(enumerate(values, start=1))):
        out = F.when(col == v, F.lit(i)).otherwise(out)
    return out


def _sum(terms: list[Column]) -> Column:
    return reduce(add, terms)


def _bins(width: float) -> int:
    return ceil(MAX_SCORE / width)


def block_bound(width: float) -> int:
    """The largest possible number of blocks at that bin width."""
    labels = len(vocab.BUDGET_LABELS) + 1
    atmospheres = len(vocab.ATMOSPHERES) + 1
    facets = 2 ** len(FACETS)
    return labels * atmospheres * 2 ** len(vocab.PURPOSES) * facets * _bins(width) ** len(vocab.SCORE_COLS)


def _block_id(width: float) -> Column:
    """Facets, label, atmosphere, purposes and score bins packed into one number, injectively."""
    bins = _bins(width)
    out = F.col("bits").cast("bigint") * F.lit(len(vocab.BUDGET_LABELS) + 1) + F.col("label")
    out = out * F.lit(len(vocab.ATMOSPHERES) + 1) + F.col("v_atmosphere")
    out = out * F.lit(2 ** len(vocab.PURPOSES)) + F.col("v_purposes")
    for s in _SCORES:
        place = F.floor(F.col(s) * F.lit(MAX_SCORE / width))
        out = out * F.lit(bins) + F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))
    return out


def distinct_venue_vectors(venues: DataFrame, k: int, own_labels: bool = False, facets: bool = False) -> DataFrame:
    """One row per distinct feature vector, with the ``k`` smallest ids that carry it.

    The rank limit is applied per task before the shuffle, so a vector shared by a third
    of all venues moves at most ``k`` rows per task.  ``own`` is the label as text if labels
    are compared, ``bits`` the facets that a venue has if users ask for some.
    """
    df = with_budget_label(venues)
    tags = F.coalesce(tag_list(df), F.array().cast("array<string>"))
    mask = _sum(
        [
            F.when(F.array_contains("tags", p), F.lit(2**i)).otherwise(F.lit(0))
            for i, p in enumerate(vocab.PURPOSES)
        ]
    )
    coded = df.withColumn("tags", tags).select(
        "cafe_id",
        (F.coalesce("budget_label", F.lit(_ANY_SCOPE)) if own_labels else F.lit(_ANY_SCOPE)).alias("own"),
        (_bits(_facet_tests()) if facets else F.lit(0)).alias("bits"),
        _index(F.col("budget_label"), vocab.BUDGET_LABELS).alias("label"),
        _index(F.col("atmosphere"), vocab.ATMOSPHERES).alias("v_atmosphere"),
        mask.alias("v_purposes"),
        *[unit_score(F.col(c)).alias(s) for c, s in zip(vocab.SCORE_COLS, _SCORES)],
        budget_fraction(F.col("budget_label")).alias("v_budget"),
    )
    key = ["own", "bits", "label", "v_atmosphere", "v_purposes", *_SCORES, "v_budget"]
    first = Window.partitionBy(*key).orderBy("cafe_id")
    squared = _sum(
        [(F.when(F.col("v_atmosphere") > 0, 1).otherwise(0) + F.bit_count("v_purposes")).cast("double")]
        + [F.col(s) * F.col(s) for s in _SCORES]
        + [F.col("v_budget") * F.col("v_budget")]
    )
    return (
        coded.dropna(subset=_SCORES)
        .withColumn("copy", F.row_number().over(first))
        .filter(F.col("copy") <= k)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("cafe_id")).alias("cafe_ids"))
        .withColumn("v_norm", F.sqrt(squared))
    )


def _components() -> dict[str, Column]:
    """Components of the normalised venue vector; ``hit`` stands for each 1 in it."""
    parts = {"hit": F.lit(1.0) / F.col("v_norm")}
    parts |= {s: F.col(s) / F.col("v_norm") for s in _SCORES}
    return parts | {"v_budget": F.col("v_budget") / F.col("v_norm")}


def _block_summaries(vectors: DataFrame, blocks: list[str]) -> DataFrame:
    ranges = []
    for name, part in _components().items():
        ranges += [F.min(part).alias(f"lo_{name}"), F.max(part).alias(f"hi_{name}")]
    return vectors.groupBy(*blocks, "bits", "label", "v_atmosphere", "v_purposes").agg(
        F.sum(F.size("cafe_ids")).alias("n_venues"), *ranges
    )


def _first_width(vectors: DataFrame, widths: tuple[float, ...] | None) -> tuple[float, ...]:
    """The widths asked for, or the finest first one that fits and a finer one for crowded blocks."""
    tried = widths[:1] if widths else WIDTHS
    if vectors.limit(MAX_BLOCKS + 1).count() <= MAX_BLOCKS:  # no more blocks than vectors
        return widths or WIDTHS[:1]
    counts = [F.approx_count_distinct(_block_id(w), 0.01).alias(f"w{i}") for i, w in enumerate(tried)]
    found = vectors.agg(F.count("*").alias("n"), *counts).first()
    # A tenth is left for the error of the count; the summaries are counted again before they are collected.
    fits = [(w, found[f"w{i}"]) for i, w in enumerate(tried) if min(block_bound(w), 1.1 * found[f"w{i}"]) <= MAX_BLOCKS]
    if not fits:
        raise ValueError(f"first bin width {tried[-1]} gives more than {MAX_BLOCKS} blocks")
    if widths:
        return widths
    width, blocks = fits[0]
    return (width, width / 4) if found["n"] > CROWDED * blocks else (width,)


def _layout_rows(hit: np.ndarray, atmosphere: np.ndarray, purposes: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    """Rows in the feature layout: ``hit`` at the places of the atmosphere and the purposes, then the rest."""
    places = [atmosphere == i + 1 for i in range(_N_ATMOSPHERES)]
    places += [(purposes >> i) & 1 == 1 for i in range(_N_PURPOSES)]
    return np.stack([np.where(p, hit, 0.0) for p in places] + rest, axis=1)


def _mark(bits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Facets and, above them, one bit for a label; no label bit where it is negative."""
    return bits | np.where(label >= 0, 1 << (len(FACETS) + np.maximum(label, 0)), 0)


def block_tree(vectors: DataFrame, block: str) -> dict | None:
    """The search tree over the blocks of ``vectors``; ``ids`` are the blocks.  None without vectors."""
    rows = _block_summaries(vectors, [block]).limit(MAX_BLOCKS + 1).toPandas()
    if len(rows) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks")
    if not len(rows):
        return None
    sides = []
    for side in ("lo", "hi"):
        rest = [rows[f"{side}_{c}"].to_numpy(float) for c in [*_SCORES, "v_budget"]]
        places = (rows[c].to_numpy(np.int64) for c in ("v_atmosphere", "v_purposes"))
        sides.append(_layout_rows(rows[f"{side}_hit"].to_numpy(float), *places, rest))
    marks = _mark(rows["bits"].to_numpy(np.int64), rows["label"].to_numpy(np.int64))
    tree = build_tree(*sides, rows["n_venues"].to_numpy(np.int64), marks)
    return tree | {"ids": rows[block].to_numpy(np.int64)}


def user_rows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The users' vectors, and the marks that they ask of a block."""
    rest = [frame[c].to_numpy(float) for c in [*_WEIGHTS, "u_budget"]]
    places = (frame[c].to_numpy(np.int64) for c in ("u_atmosphere", "u_purpose"))
    vectors = _layout_rows(np.ones(len(frame)), *places, rest)
    return vectors, _mark(frame["need"].to_numpy(np.int64), frame["asked_label"].to_numpy(np.int64))


def _opened(tree, block: str, k: int):
    """Each user once for every block that may hold one of the best ``k``, with the proven limit."""

    def run(frames):
        for frame in frames:
            users, blocks, limits, _ = search_tree(tree.value, *user_rows(frame), k)
            found = frame.iloc[users].reset_index(drop=True)
            limit = np.where(np.isfinite(limits), limits, np.nan)[users]
            yield found.assign(limit=limit, **{block: tree.value["ids"][blocks]})[[*_USER, "limit", block]]

    return run


def _matches() -> Column:
    """How many ones the user's and the venue's indicator parts share (0, 1 or 2)."""
    same = F.when(
        (F.col("u_atmosphere") > 0) & (F.col("u_atmosphere") == F.col("v_atmosphere")), F.lit(1)
    ).otherwise(F.lit(0))
    return same + F.when(F.col("u_purpose").bitwiseAND(F.col("v_purposes")) > 0, F.lit(1)).otherwise(
        F.lit(0)
    )


def _bound(upper: bool) -> Column:
    """A bound for the dot product of the user with any normalised vector of a block."""
    rising, falling = ("hi_", "lo_") if upper else ("lo_", "hi_")
    terms = [_matches().cast("double") * F.col(f"{rising}hit")]
    for p, s in zip(_WEIGHTS, _SCORES):
        edge = F.when(F.col(p) >= 0, F.col(rising + s)).otherwise(F.col(falling + s))
        terms.append(F.col(p) * edge)
    terms.append(F.col("u_budget") * F.col(f"{rising}v_budget"))
    return _sum(terms)


def _facet_tests() -> list[Column]:
    return [facet_condition(**{name: True}) for name in FACETS.values()]


def _bits(tests: list[Column]) -> Column:
    return _sum([F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)])


def _users(prefs: DataFrame, match_budget: bool, match_facets: bool) -> DataFrame:
    if match_budget and "budget" in prefs.columns:
        # No label of one's own asks for any budget; the vector takes the middle one for both.
        prefs = prefs.withColumn("budget", F.coalesce(F.col("budget"), F.lit(vocab.ANY_BUDGET)))
    asked = tuple(c for c in FACETS if match_facets and c in prefs.columns)
    df = complete_prefs(prefs, asked)
    scope = F.lit(_ANY_SCOPE)
    if match_budget:
        scope = F.when(F.col("budget") == vocab.ANY_BUDGET, F.lit(_ANY_SCOPE)).otherwise(F.col("budget"))
    need = _bits([F.col(c) if c in asked else F.lit(False) for c in FACETS])
    purpose = F.lit(0)
    for i, p in enumerate(vocab.PURPOSES):
        purpose = F.when(F.col("purpose") == p, F.lit(2**i)).otherwise(purpose)
    coded = df.select(
        "user_id",
        _index(F.col("atmosphere"), vocab.ATMOSPHERES).alias("u_atmosphere"),
        purpose.alias("u_purpose"),
        *[F.col(p).alias(w) for p, w in zip(vocab.PRIORITIES, _WEIGHTS)],
        budget_fraction(F.col("budget")).alias("u_budget"),
        scope.alias("scope"),
        need.alias("need"),
    )
    known = F.when(F.col("u_atmosphere") > 0, 1).otherwise(0) + F.when(
        F.col("u_purpose") > 0, 1
    ).otherwise(0)
    squared = _sum(
        [known.cast("double")]
        + [F.col(w) * F.col(w) for w in _WEIGHTS]
        + [F.col("u_budget") * F.col("u_budget")]
    )
    shaped = coded.withColumn("u_norm", F.sqrt(squared))
    key = F.concat_ws("-", F.xxhash64(*_SHAPE), F.xxhash64(F.lit(1), *_SHAPE))  # 128 bits
    return shaped.select("user_id", key.alias("u_key"), *_SHAPE)


def _narrow(candidates: DataFrame, blocks: DataFrame, on: str | list[str], k: int) -> DataFrame:
    """Candidates joined with the blocks that may still hold one of the user's best ``k``.

    ``candidates`` carries ``limit``, a proven lower limit of the k-th best; it is raised
    by the best lower bound among the blocks that hold ``k`` venues.
    """
    proven = (
        candidates.join(blocks, on)
        .filter(F.col("n_venues") >= k)
        .groupBy("u_key")
        .agg(F.max(_bound(upper=False)).alias("found"))
    )
    raised = candidates.join(proven, "u_key", "left").withColumn(
        "limit", F.greatest("limit", "found")
    )
    reachable = F.col("limit").isNull() | (_bound(upper=True) >= F.col("limit") - F.lit(MARGIN))
    return raised.drop("found").join(blocks, on).filter(reachable)


def _dot() -> Column:
    return _sum(
        [_matches().cast("double")]
        + [F.col(s) * F.col(w) for s, w in zip(_SCORES, _WEIGHTS)]
        + [F.col("v_budget") * F.col("u_budget")]
    )


def recommend(
    venues: DataFrame,
    prefs: DataFrame,
    k: int = 5,
    budget_label: str | None = None,
    method: str = "cosine",
    match_budget: bool = False,
    widths: tuple[float, ...] | None = None,
    match_facets: bool = False,
) -> DataFrame:
    """``(user_id, rank, cafe_id, similarity, match_score)``, at most ``k`` rows per user.

    ``budget_label`` keeps only venues with that label for everybody (``None`` or
    ``'Any'``: all); ``match_budget`` keeps for each user the venues with the user's own
    label, compared as text; null, ``''`` and ``'Any'`` ask for any.  ``match_facets`` keeps the
    venues that fit the user's own check boxes, the columns ``FACETS`` of ``prefs`` where there.
    ``method='knn'`` ranks by cosine distance and adds ``distance``.  Chosen by the unrounded
    similarity, ranked by the rounded ``match_score``; ties go to the smaller ``cafe_id``.  Venues
    with a null score are not ranked.

    ``widths`` are the score-bin widths of the block levels, coarse to fine, by default as the
    number of vectors asks for.  The first level is searched as a tree, of at most ``MAX_BLOCKS``
    blocks; a further level is joined on the block above, by shuffle.
    """
    if method not in ("cosine", "knn"):
        raise ValueError(f"unknown method: {method}")

    venues = keep_label(with_budget_label(venues), budget_label)
    vectors = written(distinct_venue_vectors(venues, k, match_budget, match_facets), "venue-vectors")
    widths = _first_width(vectors, widths)
    blocks = [f"block{i}" for i in range(len(widths))]
    vectors = vectors.withColumns({b: _block_id(w) for b, w in zip(blocks, widths)})
    users = _users(prefs, match_budget, match_facets)
    distinct = users.drop("user_id").dropDuplicates(["u_key"])
    distinct = distinct.repartition(task_count(prefs.sparkSession), "u_key")
    label = _index(F.col("scope"), vocab.BUDGET_LABELS, -1)
    distinct = distinct.withColumn("asked_label", label)

    known = distinct.where((F.col("scope") == _ANY_SCOPE) | (F.col("asked_label") >= 0))
    scored = _scored_by_tree(known, vectors, blocks, k)
    own = vectors.where((F.col("label") == 0) & (F.col("own") != _ANY_SCOPE))
    if match_budget and not own.isEmpty():
        asking = distinct.where((F.col("scope") != _ANY_SCOPE) & (F.col("asked_label") < 0))
        scored = scored.union(_scored_by_label(asking, own, blocks[0], k))
    return _ranked(users, scored, k, method)


def _similarity() -> Column:
    return (_dot() / (F.col("v_norm") * F.col("u_norm"))).alias("similarity")


def _scored_by_tree(users: DataFrame, vectors: DataFrame, blocks: list[str], k: int) -> DataFrame:
    """(u_key, cafe_ids, similarity) of users who ask for a known label or any."""
    spark = users.sparkSession
    tree = block_tree(vectors, blocks[0])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in users.schema if f.name in _USER)
    schema = f"{fields}, `limit` double, `{blocks[0]}` bigint"
    if tree is None:
        candidates = spark.createDataFrame([], schema)
    else:
        candidates = users.mapInPandas(_opened(spark.sparkContext.broadcast(tree), blocks[0], k), schema)
    for depth in range(2, len(blocks) + 1):
        # blocks of one level need not nest in those above: a finer block is its whole path
        path = blocks[:depth]
        candidates = _narrow(candidates, _block_summaries(vectors, path), path[:-1], k).select(*_USER, "limit", *path)
    return candidates.select(*_USER, *blocks).join(vectors, blocks).select("u_key", "cafe_ids", _similarity())


def _scored_by_label(users: DataFrame, vectors: DataFrame, block: str, k: int) -> DataFrame:
    """The same for users who ask for a label of the caller's own; they meet the blocks with that label."""
    # A block is seen by users who need no more facets than it has.
    needs = F.filter(F.sequence(F.lit(0), F.col("bits")), lambda s: s.bitwiseAND(F.col("bits")) == s)
    summaries = _block_summaries(vectors, ["own", block]).withColumn("need", F.explode(needs))
    summaries = broadcast_if_small(written(summaries.withColumnRenamed("own", "scope"), "label-blocks"), MAX_BLOCKS)
    limited = users.withColumn("limit", F.lit(None).cast("double"))
    candidates = _narrow(limited, summaries, ["scope", "need"], k).select(*_USER, block)
    met = candidates.join(vectors.withColumnRenamed("own", "scope"), ["scope", block])
    return met.select("u_key", "cafe_ids", _similarity())


def _ranked(users: DataFrame, scored: DataFrame, k: int, method: str) -> DataFrame:
    """The best ``k`` of each distinct set of preferences, then of each user."""
    order_value = -F.col("similarity") if method == "cosine" else F.lit(1.0) - F.col("similarity")
    best_vectors = Window.partitionBy("u_key").orderBy(F.col("order_value"), F.element_at("cafe_ids", 1))
    chosen = Window.partitionBy("u_key").orderBy("order_value", "cafe_id")
    picked = (
        scored.withColumn("order_value", order_value)
        .withColumn("place", F.row_number().over(best_vectors))
        .filter(F.col("place") <= k)
        .select("u_key", "order_value", "similarity", F.explode("cafe_ids").alias("cafe_id"))
        .withColumn("place", F.row_number().over(chosen))
        .filter(F.col("place") <= k)
    )
    if method == "knn":
        picked = picked.withColumn("distance", F.col("order_value")).withColumn(
            "similarity", distance_to_similarity(F.col("distance"))
        )
    shown = Window.partitionBy("u_key").orderBy(
        F.col("match_score").desc(), F.col("similarity").desc(), "cafe_id"
    )
    extra = ["distance"] if method == "knn" else []
    ranked = picked.withColumn("match_score", percent(F.col("similarity"))).select(
        "u_key",
        F.row_number().over(shown).alias("rank"),
        "cafe_id",
        "similarity",
        *extra,
        "match_score",
    )
    return users.select("user_id", "u_key").join(ranked, "u_key").drop("u_key")


def attach_venues(matches: DataFrame, venues: DataFrame) -> DataFrame:
    """The matched venues' own columns next to each match."""
    return matches.join(venues, "cafe_id")
