"""Toxicity: a factorization machine over hashed terms.

A text becomes the set of its terms: words in lower case and the first letters of longer
words (which catch inflected forms), hashed into a fixed number of buckets.  The model has
a weight and a short vector per bucket; the product of two vectors is the weight of the
pair, so "insult with group mention" can count more than both words alone.  It is fitted on
a bounded sample of labelled texts, over the buckets that tell the classes apart best in
that sample; other buckets have no weight.

Edge cases: a null or empty text has no terms and gets the score of the bias; repeated
terms count once; without labels of both classes the score is the smoothed share of class
1; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens.llm.common import bounded_labels
from venuelens.session import written

#: Labelled documents that are used to fit, at most (in expectation; picked by hash).
LABEL_BOUND = 20_000
#: Hash buckets, and how many of them the model has weights for.
BUCKETS = 1 << 20
FEATURES = 4096
#: Least log-likelihood ratio of a bucket against the classes; below it lies chance among many buckets.
MIN_GAIN = 15.0

_WORD = re.compile(r"[^\W\d_]+")
_STEM = 5
_KNOWN_WORDS = 1 << 19


class _Terms(dict):
    """The buckets of a word: of itself and, if it is longer, of its first letters."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = (zlib.crc32(word.encode()) % BUCKETS,)
        if len(word) > _STEM:
            found += (zlib.crc32(b"^" + word[:_STEM].encode()) % BUCKETS,)
        if len(self) < _KNOWN_WORDS:
            self[word] = found
        return found


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _buckets_of(texts: pd.Series) -> pd.Series:
    terms = _Terms()
    return pd.Series([sorted({b for w in _words(x) for b in terms[w]}) for x in texts])


@dataclass(frozen=True)
class Machine:
    """Bias, and for each chosen bucket its place; weights and factors by place."""

    bias: float
    place: dict[int, int]
    weight: np.ndarray
    factors: np.ndarray

    def margin(self, places: list[int]) -> float:
        if not places:
            return self.bias
        v = self.factors[places]
        s = v.sum(axis=0)
        return float(self.bias + self.weight[places].sum() + 0.5 * (s @ s - (v * v).sum()))


def _surprise(seen: Column, expected: Column) -> Column:
    """A cell's part of the log-likelihood ratio."""
    return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)


def _fit(sets: list[np.ndarray], y: np.ndarray, size: int, rank: int, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the log loss over mini-batches of rows in sparse form."""
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.02, (size, rank))], axis=1)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(max(epochs, 600 * 512 // max(512, len(sets)))):
        order = rng.permutation(len(sets))
        for at in range(0, len(order), 512):
            chosen = order[at : at + 512]
            lengths = np.array([len(sets[i]) for i in chosen])
            cols = np.concatenate([sets[i] for i in chosen]) if lengths.sum() else np.zeros(0, int)
            row = np.repeat(np.arange(len(chosen)), lengths)
            part = theta[cols]
            sums = np.zeros((len(chosen), rank + 1))
            np.add.at(sums, row, part)
            squares = np.bincount(row, (part[:, 1:] ** 2).sum(axis=1), len(chosen))
            margin = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[chosen]) / len(chosen)
            grad = np.zeros_like(theta)
            each = np.concatenate([np.ones((len(cols), 1)), sums[row, 1:] - part[:, 1:]], axis=1)
            np.add.at(grad, cols, each * error[row][:, None])
            grad += 2e-5 * theta
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            theta -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            bias -= 0.05 * float(error.sum())
    return bias, theta[:, 0], theta[:, 1:]


def train(
    docs: DataFrame, labels: DataFrame, keep: Column | None = None, bound: int = LABEL_BOUND,
    features: int = FEATURES, rank: int = 8, epochs: int = 25, seed: int = 7,
) -> Machine:
    """Fit on documents with a ``toxic`` label, at most about ``bound`` of them.

    The sample of labels is broadcast, so no text is shuffled; its hashed terms are
    written once.  The buckets are ranked by Spark; the rows of the sample, cut down to
    these buckets, are fitted by one task, whose input ``bound`` and ``features`` limit.
    """
    sample = bounded_labels(labels, "toxic", F.lit(True) if keep is None else keep, bound)
    text = docs.select(F.col("doc_id"), F.col("text"))
    terms = written(text.join(F.broadcast(sample), "doc_id").select("y", _buckets_of("text").alias("terms")), "toxicity-terms")
    n, ones = terms.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    empty = Machine(bias, {}, np.zeros(0), np.zeros((0, rank)))
    if not 0 < ones < n:
        return empty
    in_one, in_zero = F.sum("y"), F.count("*") - F.sum("y")
    a, both = F.col("a"), F.col("a") + F.col("b")
    gain = _surprise(a, both * (ones / n)) + _surprise(F.col("b"), both * (1 - ones / n))
    gain += _surprise(ones - a, (n - both) * (ones / n)) + _surprise(n - ones - F.col("b"), (n - both) * (1 - ones / n))
    ranked = (
        terms.select("y", F.explode("terms").alias("bucket"))
        .groupBy("bucket")
        .agg(in_one.alias("a"), in_zero.alias("b"))
        .where(2 * gain >= MIN_GAIN)
        .orderBy(gain.desc(), "bucket")
        .limit(features)
    )
    place = {r["bucket"]: i for i, r in enumerate(ranked.collect())}
    if not place:
        return empty

    def fit(batches):
        sets, ys = [], []
        for batch in batches:
            ys.extend(batch["y"])
            sets.extend(np.array([place[b] for b in row if b in place], int) for row in batch["terms"])
        bias, weight, factors = _fit(sets, np.array(ys, float), len(place), rank, epochs, seed)
        yield pd.DataFrame({"bias": [bias], "model": [np.concatenate([weight, factors.ravel()])]})

    got = terms.orderBy("y", F.xxhash64("terms")).coalesce(1).mapInPandas(fit, "bias double, model array<double>").first()
    model = np.array(got["model"])
    size = len(place)
    return Machine(got["bias"], place, model[:size], model[size:].reshape(size, rank))


def toxicity_score(text: Column, model: Machine) -> Column:
    """Column with the score of a text: 0 to 1, higher means toxic is likelier."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        class Places(dict):
            """The places that a word's terms have in the model."""

            def __missing__(self, word: str) -> tuple[int, ...]:
                found = tuple(model.place[b] for b in terms[word] if b in model.place)
                if len(self) < _KNOWN_WORDS:
                    self[word] = found
                return found

        terms, places = _Terms(), Places()
        margins = [model.margin(sorted({p for w in _words(x) for p in places[w]})) for x in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(margins, float), -50, 50))))

    return score(text)
