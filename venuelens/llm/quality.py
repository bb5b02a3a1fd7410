"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of statistics (length, word forms, symbols, repetition,
lines), shares on the arcsine scale and counts on the log scale, so that each class is
roughly normal.  The covariance of a class is shrunk towards the pooled one and towards a
multiple of the identity.  A score is the logistic of the difference of the two log
densities, each from the Mahalanobis distance by a Cholesky factor computed once.

Edge cases: a null text counts as empty; an empty text has all statistics zero and is
scored like any other; without labels, or with one class only, the score is the smoothed
share of class 1; repeated rows are scored one by one; null labels teach nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens.llm.common import bounded_labels

#: Labelled documents that are used to fit, at most (in expectation; picked by hash).
LABEL_BOUND = 20_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PROSE = np.zeros(256, bool)
_PROSE[[ord(c) for c in ".,;:?'\"()-"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = ~(_LETTERS | _PROSE | _BLANK)
_SYMBOL[48:58] = False

#: Length of the vector that ``statistics`` returns.
N_STATS = 11


def _share(part: float, whole: float) -> float:
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    bytes_of = np.bincount(raw, minlength=256)
    words = text.split()
    n, size = len(words), len(raw)
    lines = [x for x in text.split("\n") if x]
    seen = bytes_of[bytes_of > 0] / max(1, size)
    repeats = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    lengths = np.fromiter(map(len, words), np.int32, n)
    return [
        math.log1p(n),
        math.log1p(len(text) / n) if n else 0.0,
        math.log1p(float(lengths.std())) if n else 0.0,
        _share(bytes_of[65:91].sum(), size),
        _share(bytes_of[_SYMBOL].sum(), size),
        _share(bytes_of[_PROSE].sum(), size),
        _share(bytes_of[48:58].sum(), size),
        _share(len(set(words)), n),
        _share(repeats, n),
        math.log1p(len(lines) / n) if n else 0.0,
        float(-(seen * np.log(seen)).sum()),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Centre and scale of the statistics; mean, inverse Cholesky factor and offset of each class.

    ``classes`` is empty if a class has no rows; ``prior`` then is the score.
    """

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [off - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, off in self.classes]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -50, 50)))


def fit_discriminant(rows: DataFrame, pooled: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """Fit from rows (y, x array).  Only the moments of the two classes reach the driver.

    ``pooled``: weight of the common covariance in that of a class; ``ridge``: weight of
    the identity after that.
    """
    d = N_STATS
    at = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(at)]
    products = [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect()}
    n = {y: got[y]["n"] if y in got else 0 for y in (0, 1)}
    total = n[0] + n[1]
    prior = (n[1] + 1) / (total + 2)
    if not n[0] or not n[1]:
        return Discriminant(np.zeros(d), np.ones(d), (), prior)
    mean, second = {}, {}
    for y, r in got.items():
        mean[y] = np.array([r[f"s{i}"] for i in range(d)]) / n[y]
        second[y] = np.zeros((d, d))
        for i, j in pairs:
            second[y][i, j] = second[y][j, i] = r[f"p{i}_{j}"] / n[y]
    centre = (n[0] * mean[0] + n[1] * mean[1]) / total
    spread = (n[0] * np.diag(second[0]) + n[1] * np.diag(second[1])) / total - centre**2
    # Below this floor a statistic is as good as constant, and a small step would outweigh all others.
    scale = np.maximum(np.sqrt(np.maximum(spread, 0)), 0.05)
    within = {y: (second[y] - np.outer(mean[y], mean[y])) / np.outer(scale, scale) for y in (0, 1)}
    common = (n[0] * within[0] + n[1] * within[1]) / total
    classes = []
    for y in (0, 1):
        cov = (1 - pooled) * within[y] + pooled * common
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        offset = math.log((n[y] + 1) / (total + 2)) - float(np.log(np.diag(factor)).sum())
        classes.append(((mean[y] - centre) / scale, np.linalg.inv(factor), offset))
    return Discriminant(centre, scale, tuple(classes), prior)


def _vectors(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(x) for x in texts], float).reshape(-1, N_STATS)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_vectors(texts)))


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, bound: int = LABEL_BOUND) -> Discriminant:
    """Fit on documents with a ``quality`` label.

    ``keep``: condition on ``doc_id`` that labels must meet to be learnt from.  The sample
    of labels has at most about ``bound`` rows and is broadcast, so no text is shuffled.
    """
    sample = bounded_labels(labels, "quality", F.lit(True) if keep is None else keep, bound)
    text = docs.select(F.col("doc_id"), F.col("text"))
    rows = text.join(F.broadcast(sample), "doc_id").select("y", _statistics_of("text").alias("x"))
    return fit_discriminant(rows)


def quality_score(text: Column, model: Discriminant) -> Column:
    """Column with the score of a text: 0 to 1, higher means class 1 is likelier."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_vectors(texts)))

    return score(text)
