"""Benchmark decontamination: seeds of two words, then Smith-Waterman alignment of words.

The test items are a stated query set, taken in blocks of bounded size.  One scan of the
corpus looks up every two neighbouring words of an item in each document, as neighbours or
with one word between them.  An alignment of score ``S`` to an item of ``n`` words holds at
least ``(2 S - n) / 3 - 1`` such seeds, whose places differ by ``2 n - S`` at most; where
fewer lie that close together the score can't be reached, and no other place is left out.
The window around the rest is aligned with the item word by word, so edited and
paraphrased copies still score.  Only hits leave the scan; no text is shuffled.

The score of an alignment is its Smith-Waterman score over the score of a perfect copy.

Edge cases: null and empty texts and items never match; an item of fewer than ``MIN_WORDS``
words matches only a document that has exactly these words; repeated items and repeated rows
give the hits of each, with one row per (doc_id, item_id), the best; without items there are no hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
MIN_WORDS = 5
#: Items of fewer words need a higher score.
SHORT_WORDS = 10
#: Characters of item texts that one scan takes.
BLOCK_CHARS = 16_000_000

_WORD = re.compile(r"\w+")
_MATCH, _MISS, _GAP = 2, -1, -1
_HITS = "doc_id string, item_id bigint, score double, n_matched int, n_words int, start bigint, end bigint"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, matched words, and its bounds in ``window``.

    Row by row over the item; each cell carries where its alignment began and its matches.
    """
    n = len(window)
    place = np.arange(n)
    score, began, matched = np.zeros(n, int), place.copy(), np.zeros(n, int)
    best = (0, 0, 0, 0)
    for word in item:
        hit = window == word
        diagonal = np.concatenate([[0], score[:-1]])
        from_left = diagonal > 0
        came = np.where(from_left, np.concatenate([[0], began[:-1]]), place)
        had = np.where(from_left, np.concatenate([[0], matched[:-1]]), 0) + hit
        now = diagonal + np.where(hit, _MATCH, _MISS)
        up = score + _GAP > now
        now, came, had = np.where(up, score + _GAP, now), np.where(up, began, came), np.where(up, matched, had)
        # Gaps along the window: the best start to the left, less a gap for each step.
        lead = now - _GAP * place
        top = np.maximum.accumulate(lead)
        origin = np.maximum.accumulate(np.where(lead == top, place, 0))
        score = np.maximum(top + _GAP * place, 0)
        began, matched = came[origin], had[origin]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(matched[at]), int(began[at]), at + 1)
    return best


def needed(n_words: int, min_score: float) -> int:
    """Smith-Waterman score from which an item of so many words counts as copied.

    Of under ``SHORT_WORDS`` words one may be replaced, or two from 8 words on, so that a shared phrase is no copy.
    """
    least = math.ceil(min_score * _MATCH * n_words - 1e-9)
    if n_words >= SHORT_WORDS:
        return least
    replaced = 1 if n_words < 8 else 2
    return max(least, _MATCH * (n_words - replaced) + _MISS * replaced)


def seeds_of(n_words: int, min_score: float) -> int:
    """Seeds that an alignment of the needed score holds at least."""
    return max(1, -(-(2 * needed(n_words, min_score) - n_words) // 3) - 1)


def reachable(item: np.ndarray, window: np.ndarray) -> int:
    """No alignment scores more: item words in the window all match, each other one between them costs one."""
    total = np.cumsum(np.where(np.isin(item, window), _MATCH, _MISS))
    return int((total - np.minimum.accumulate(np.concatenate([[0], total[:-1]]))).max())


class Items:
    """A block of test items: words as numbers, and where each pair of neighbours stands."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            found = words_of(text)
            if found:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in found]))
        self.least: dict[float, np.ndarray] = {}
        self.short: dict[tuple[int, ...], list[int]] = {}
        keys, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            if len(w) < MIN_WORDS:
                self.short.setdefault(tuple(w.tolist()), []).append(i)
                continue
            keys.append(self.keys(w[:-1], w[1:]))
            item.append(np.full(len(w) - 1, i))
            at.append(np.arange(len(w) - 1))
        keys, item, at = np.concatenate(keys), np.concatenate(item), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        self.grams, first = np.unique(keys[order], return_index=True)
        self.first, self.item, self.at = np.append(first, len(keys)), item[order], at[order]

    @staticmethod
    def keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A 64-bit key of every pair of words."""
        key = np.zeros(len(left), np.uint64)
        for words in (left, right):
            key = (key ^ words.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every seed: the item, where it would start in ``words``, and the seed's place in it."""
        items, starts, begins = [], [], []
        for gap in (1, 2):
            place = np.flatnonzero((words[:-gap] >= 0) & (words[gap:] >= 0))
            key = self.keys(words[place], words[place + gap])
            number = np.searchsorted(self.grams, key).clip(max=len(self.grams) - 1)
            hit = self.grams[number] == key
            place, number = place[hit], number[hit]
            lengths = self.first[number + 1] - self.first[number]
            where = np.repeat(self.first[number], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            items.append(self.item[where])
            begins.append(self.at[where])
            starts.append(np.repeat(place, lengths) - begins[-1])
        return np.concatenate(items), np.concatenate(starts), np.concatenate(begins)

    def candidates(self, words: np.ndarray, min_score: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Items that have as many seeds as the needed score takes, where these would start, sorted, and their places."""
        item, start, begin = self.hits(words)
        if min_score not in self.least:
            self.least[min_score] = np.array([seeds_of(len(w), min_score) for w in self.words])
        item_of, place, count = np.unique(item, return_inverse=True, return_counts=True)
        enough = (count >= self.least[min_score][item_of])[place]
        item, start, begin = item[enough], start[enough], begin[enough]
        order = np.lexsort([start, item])
        item, start, begin = item[order], start[order], begin[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1)).tolist()
        for low, high in zip(edges, [*edges[1:], len(item)], strict=False):
            yield int(item[low]), start[low:high], begin[low:high]

    def matches(self, text: str | None, min_score: float) -> list[tuple[int, float, int, int, int, int]]:
        """(item_id, score, matched words, words of the item, bounds in ``text``), the best of each item."""
        found = words_of(text)
        words = self.numbers(found)
        best: dict[int, tuple[int, int, int, int]] = {}
        if len(words) < MIN_WORDS:
            for i in self.short.get(tuple(words.tolist()), []):
                best[i] = (_MATCH * len(words), len(words), 0, len(words))
        if len(words) > 1 and len(self.grams):
            for i, starts, begins in self.candidates(words, min_score):
                if at := self._best(self.words[i], words, starts, begins, min_score):
                    best[i] = at
        out = []
        spans = [m.span() for m in _WORD.finditer((text or "").lower())] if best else []
        for i, (score, matched, begin, end) in best.items():
            n = len(self.words[i])
            out.append((self.ids[i], score / (_MATCH * n), matched, n, spans[begin][0], spans[end - 1][1]))
        return out

    @staticmethod
    def _best(item: np.ndarray, words: np.ndarray, starts: np.ndarray, begins: np.ndarray, min_score: float) -> tuple[int, int, int, int] | None:
        """The best alignment of an item that reaches the needed score, from its seeds sorted by start."""
        need = needed(len(item), min_score)
        slack = max(0, _MATCH * len(item) - need)
        seeds = seeds_of(len(item), min_score)
        close = np.flatnonzero(starts[seeds - 1 :] - starts[: len(starts) - seeds + 1] <= slack)
        if not len(close):
            return None
        kept = np.unique(close[:, None] + np.arange(seeds))
        starts, begins = starts[kept], begins[kept]
        best = (0, 0, 0, 0)
        edges = np.flatnonzero(np.diff(starts, prepend=starts[0] - slack - 1) > slack).tolist()
        for first, last in zip(edges, [*edges[1:], len(starts)], strict=True):
            if len(set(begins[first:last].tolist())) < seeds:
                continue
            low = max(0, int(starts[first]) - slack)
            high = min(len(words), int(starts[last - 1]) + len(item) + slack)
            window = words[low:high]
            if reachable(item, window) < need:
                continue
            score, matched, begin, end = align(item, window)
            if score > best[0]:
                best = (score, matched, low + begin, low + end)
        return best if best[0] >= need else None


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_CHARS`` characters, dealt by a hash; null ids or texts have no words."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        block = Items([(r["item_id"], r["text"]) for r in part.toLocalIterator()])
        if block.ids:
            yield block


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and item that it holds a copy of: doc_id, item_id, score, n_matched, n_words, start, end.

    ``start`` and ``end`` bound the copy in the lower-cased text, in characters.
    """

    def scan(block: Items):
        def search(batches):
            for batch in batches:
                found = [(d, *m) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for m in block.matches(text, min_score)]
                names = ["doc_id", "item_id", "score", "n_matched", "n_words", "start", "end"]
                yield pd.DataFrame(found, columns=names)

        return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text")).mapInPandas(search, _HITS)

    parts = [scan(block) for block in item_blocks(items)]
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], _HITS)]
    hits = reduce(DataFrame.union, parts)
    rest = ["score", "n_matched", "n_words", "start", "end"]
    best = F.max_by(F.struct(*rest), F.struct("score", -F.col("start"))).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select(F.col("doc_id").cast("bigint").alias("doc_id"), "item_id", *[f"best.{c}" for c in rest])


def holds_item(text: Column, blocks: list[Items], min_score: float = MIN_SCORE) -> Column:
    """Whether a text holds a copy of any item, for filters that keep all columns of a row."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([any(b.matches(x, min_score) for b in blocks) for x in texts], dtype=bool)

    return holds(text)
