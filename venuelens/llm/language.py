"""Language identification: each text is a mixture of languages.

From labelled texts come the probabilities of hashed character trigrams per language.  A
text's proportions of languages are found by expectation-maximisation over its trigrams.
The set of languages is chosen by penalised likelihood: starting from the single best
language, one that has a share is added while it raises the log likelihood by more than the
penalty.  The prediction is the language with the largest proportion in that set.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without labelled
texts everything is ``und``; ties go to the first language by name; very long texts
are counted whole; repeated rows are predicted one by one.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are used to fit, at most (in expectation; picked by hash).
LABEL_BOUND = 20_000
#: Hash buckets for trigrams; a model has this many rows, whatever the corpus.
BUCKETS = 1 << 15
UNDETERMINED = "und"


class _Letters:
    """Code point to itself for letters, to a space for all else; built once per process."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        if cls.table is None:
            top = 0x110000
            keep = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(top)), bool, top)
            cls.table = np.where(keep, np.arange(top, dtype=np.uint32), np.uint32(32))
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        return cls.table[points]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct buckets of a whole text and how often each occurs; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    points = _Letters.of(text)
    # One space on each side, and one for each run of other characters.
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    mixed = points[:-2] * np.uint32(2654435761) ^ points[1:-1] * np.uint32(40503 * 65537) ^ points[2:] * np.uint32(97531 * 257)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    counts = np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Mixture:
    """Languages by name and the log probabilities of the buckets, one column per language."""

    names: tuple[str, ...]
    logs: np.ndarray
    penalty: float = 3.0

    def proportions(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the chosen languages (0 for others) and the winner's share."""
        logs = self.logs[found]
        total = counts.sum()
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        single = counts @ logs
        weights = self._maximise(p, counts, np.full(len(self.names), 1 / len(self.names)))
        chosen = [int(single.argmax())]
        best = single[chosen[0]]
        others = [i for i in np.argsort(-weights, kind="stable") if weights[i] > 0.02 and i != chosen[0]]
        shift = float(counts @ logs.max(axis=1))
        out = np.zeros(len(self.names))
        out[chosen[0]] = 1.0
        for i in others:
            trial = sorted([*chosen, int(i)])
            part = self._maximise(p[:, trial], counts, np.full(len(trial), 1 / len(trial)))
            value = float(counts @ np.log(p[:, trial] @ part + 1e-300)) + shift
            if value - best > self.penalty * np.log(total + 1):
                chosen, best = trial, value
                out = np.zeros(len(self.names))
                out[chosen] = part
        return out, float(out.max())

    @staticmethod
    def _maximise(p: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = counts.sum()
        for _ in range(30):
            joint = p * weights
            new = (counts / joint.sum(axis=1).clip(1e-300)) @ joint / total
            done = np.abs(new - weights).max() < 2e-3
            weights = new
            if done:
                break
        return weights


def train(docs: DataFrame, keep: Column | None = None, bound: int = LABEL_BOUND) -> Mixture:
    """Fit on documents with a language.  Counts are summed by Spark; the model has a fixed size.

    ``keep``: condition on ``doc_id`` that documents must meet to be learnt from.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.lit(True) if keep is None else keep))
    share = min(1.0, bound / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    rows = rows.where(place < int(share * (1 << 30)))

    def count(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total = np.zeros(BUCKETS, np.int64)
                for text in texts:
                    if (got := trigrams(text)) is not None:
                        total[got[0]] += got[1]
                found = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": found, "n": total[found]})

    counts = (
        rows.select("lang", "text").mapInPandas(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    )
    got = sorted(counts.toLocalIterator(), key=lambda r: r["lang"])
    table = np.full((BUCKETS, len(got)), 0.5)
    for i, r in enumerate(got):
        table[r["b"], i] += r["n"]
    return Mixture(tuple(r["lang"] for r in got), np.log(table / table.sum(axis=0)) if got else table)


def predict_language(text: Column, model: Mixture) -> Column:
    """Struct of ``lang_pred``, ``score`` (its proportion) and ``proportions`` by language."""

    @F.pandas_udf("lang_pred string, score double, proportions map<string, double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            got = trigrams(text) if model.names else None
            if got is None:
                out.append((UNDETERMINED, 0.0, {}))
                continue
            shares, score = model.proportions(*got)
            named = {model.names[i]: float(shares[i]) for i in np.flatnonzero(shares)}
            out.append((model.names[int(shares.argmax())], min(1.0, max(0.0, score)), named))
        return pd.DataFrame(out, columns=["lang_pred", "score", "proportions"])

    return predict(text)
