"""Collocations: frequent phrases of two to five words, ranked per language by how far their parts attract each other.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and written once as
batches of word codes with the batch's own dictionary.  Then

1. words are counted; those under the threshold can be part of no frequent phrase;
2. level by level a window of ``k`` words is looked at only if both its windows of ``k - 1`` words
   may be frequent (Apriori).  Windows are counted by a 64-bit hash; a collision can only add to a
   sum, so every frequent phrase is among the windows that pass (two of them with one hash would be
   taken for one; the chance is their number times that of all distinct windows over 2 ** 64).  The next level knows them as a bitmap of
   fixed size, where a false hit also only adds;
3. the phrases that pass all levels are the candidates.  They are dealt by hash into blocks of about
   ``BLOCK_PHRASES``, and a task builds the double-array trie of a block over its words.  Each trie is
   broadcast; numpy advances the states of all text positions at once, one word deeper each time, and counts the
   states by ``bincount``.  The sums of these counts over all tasks are exact;
4. the parts of each phrase are candidates or frequent words themselves, so scores need two joins of counts.

What is broadcast is bounded: a bitmap has ``2 ** FILTER_BITS`` bits, a trie one block.  With more
candidates there are more blocks, each read against all texts.  Hash sums are combined in
the tasks before the shuffle, so a phrase that many texts hold is one row per task.

Edge cases: a null text counts as empty, a null lang as ``und``; an empty lang is a language of its own; pieces
without words count for nothing; repeated rows count each; a text of any length is read whole, as a batch
of its own; other columns of ``docs`` are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuelens.llm.common import arrow_rows
from venuelens.session import broadcast_if_small, written

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: log2 of the bits of the bitmap that tells which windows may be frequent.
FILTER_BITS = 26
#: Candidates of one trie, about.
BLOCK_PHRASES = 1 << 18

_BATCH_BYTES = 1 << 20
#: Windows that a task holds before it sums them.
_WINDOWS = 1 << 19
_SEEN = 1 << 19
#: Rows of an Arrow batch: texts, and batches of words of about a megabyte each.
_TEXT_ROWS, _BATCH_ROWS = 1000, 4
#: Languages whose word totals are broadcast, at most; more are joined by a shuffle.
_LANGS = 100_000
_BREAK = b"\xff"  # no byte of a UTF-8 text
_TABLE = bytes(
    ord(_BREAK) if b in b".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_BLOCK_BITS = 15
#: States of a trie whose counts travel in one row.
_STATES = 1 << 12
#: Share of the batches that are read for the words of phrases first.
_SHARE = 16


# -- batches of words ----------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """The words of a text in order; ``_BREAK`` stands between pieces."""
    return text.encode("utf-8", "replace").translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _coded(tokens: list[bytes]) -> tuple[bytes, bytes, int]:
    """The distinct words, blank between them; the codes (0: between pieces) as int32; the number of words."""
    codes = dict.fromkeys(tokens)
    codes.pop(_BREAK, None)
    for k, word in enumerate(codes, 1):
        codes[word] = k
    vocabulary = b" ".join(codes)
    codes[_BREAK] = 0
    row = np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
    return vocabulary, row.tobytes(), int(np.count_nonzero(row))


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def row(lang: str) -> pd.DataFrame:
        vocabulary, codes, n = _coded(tokens.pop(lang))
        del sizes[lang]
        return pd.DataFrame({"lang": [lang], "vocabulary": [vocabulary], "codes": [codes], "n_words": [n]})

    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            tokens.setdefault(lang, []).extend([*words_of(text), _BREAK])
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > _BATCH_BYTES:
                yield row(lang)
            elif len(sizes) > 16 and sum(sizes.values()) > 4 * _BATCH_BYTES:  # many languages
                yield row(max(sizes, key=sizes.get))
    for lang in list(tokens):
        yield row(lang)


def _read_all(batches: DataFrame, function, schema: str, reduced, name: str) -> DataFrame:
    """One reading of all batches: ``reduced`` of the rows that ``function`` makes of them, written."""
    with arrow_rows(batches.sparkSession, _BATCH_ROWS):
        return written(reduced(batches.mapInPandas(function, schema)), name)


def _read(frame: pd.DataFrame) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    for lang, vocabulary, codes in zip(frame["lang"], frame["vocabulary"], frame["codes"], strict=True):
        yield lang, vocabulary.split(), np.frombuffer(codes, np.int32)


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, words, codes in _read(frame):
            if not words:
                continue
            counts = np.bincount(codes, minlength=len(words) + 1)[1:]
            yield pd.DataFrame({"lang": [lang] * len(words), "phrase": [w.decode() for w in words], "f": counts})


# -- windows that may be frequent ----------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


class _Windows:
    """Hashes of the windows of a batch, by length; ``inside`` tells the windows that cross no break."""

    def __init__(self, lang: str, words: list[bytes], codes: np.ndarray):
        self.first = np.concatenate([np.zeros(1, np.uint64), word_hashes(lang, words)])[codes]
        self.words = codes > 0
        self.hashes, self.inside, self.length = self.first, self.words, 1

    def grow(self) -> None:
        k = self.length
        if len(self.hashes):
            self.hashes = _mixed(self.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.first[k:])
            self.inside = self.inside[:-1] & self.words[k:]
        self.length += 1

    def passing(self, bitmap: np.ndarray) -> np.ndarray:
        return self.inside & _bits(bitmap, self.hashes)


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = _place(hashes)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _window_sums(length: int, bitmap):
    """Rows (h, f): hashes of windows of ``length`` words whose two shorter windows pass ``bitmap``."""

    def run(frames):
        held: list[np.ndarray] = []

        def sums() -> pd.DataFrame:
            h, f = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pd.DataFrame({"h": h.view(np.int64), "f": f})

        for frame in frames:
            for lang, words, codes in _read(frame):
                windows = _Windows(lang, words, codes)
                while windows.length < length - 1:
                    windows.grow()
                passing = windows.passing(bitmap.value)
                windows.grow()
                if len(passing) > 1:
                    held.append(windows.hashes[passing[:-1] & passing[1:]])
                if sum(map(len, held)) > _WINDOWS:
                    yield sums()
        if held:
            yield sums()

    return run


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bits = np.zeros((len(frame), 1 << _BLOCK_BITS), np.uint8)
        for k, places in enumerate(frame["places"]):
            bits[k, np.asarray(places, np.int64)] = 1
        packed = np.packbits(bits, axis=1, bitorder="little")
        yield pd.DataFrame({"block": frame["block"], "bits": [x.tobytes() for x in packed]})


def _bitmap(hashes: DataFrame):
    """The broadcast bitmap of the hashes ``h``, of fixed size; put together from blocks that tasks have packed."""
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    places = hashes.select(F.shiftright(place, _BLOCK_BITS).alias("block"), place.bitwiseAND((1 << _BLOCK_BITS) - 1).alias("place"))
    blocks = places.groupBy("block").agg(F.collect_set("place").alias("places"))  # at most 2 ** _BLOCK_BITS of them
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (_BLOCK_BITS - 3)
    for row in blocks.mapInPandas(_packed, "block bigint, bits binary").collect():  # the bitmap's own size, at most
        bitmap[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def _passing_phrases(bitmap, longest: int):
    """Rows (lang, phrase, h) of the windows of two to ``longest`` words that pass the bitmap, each once in a task."""

    def run(frames):
        seen: set[int] = set()
        for frame in frames:
            for lang, words, codes in _read(frame):
                windows, out = _Windows(lang, words, codes), []
                for _ in range(longest - 1):
                    windows.grow()
                    at = np.flatnonzero(windows.passing(bitmap.value))
                    hashes, first = np.unique(windows.hashes[at], return_index=True)
                    for h, i in zip(hashes.view(np.int64).tolist(), at[first].tolist(), strict=True):
                        if h not in seen:
                            seen.add(h)
                            out.append((lang, b" ".join(words[c - 1] for c in codes[i : i + windows.length]).decode(), h))
                if len(seen) > _SEEN:
                    seen.clear()
                if out:
                    yield pd.DataFrame(out, columns=["lang", "phrase", "h"])

    return run


def candidate_phrases(batches: DataFrame, frequent_words: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(lang, phrase): all phrases of two to ``longest`` words that may occur ``min_count`` times."""

    @F.pandas_udf("bigint")
    def hashed(langs: pd.Series, words: pd.Series) -> pd.Series:
        one = [word_hashes(lang, [word.encode()])[0] for lang, word in zip(langs, words, strict=True)]
        return pd.Series(np.array(one, np.uint64).view(np.int64))

    passing = frequent_words.select(hashed("lang", "phrase").alias("h"))
    hashes = None
    for length in range(2, longest + 1):
        bitmap = _bitmap(passing)
        passing = _read_all(
            batches, _window_sums(length, bitmap), "h bigint, f bigint",
            lambda x: x.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("h"), "windows",
        )
        bitmap.destroy()
        if passing.isEmpty():
            break
        hashes = passing if hashes is None else hashes.union(passing)
    if hashes is None:
        return frequent_words.select("lang", "phrase").limit(0)
    # Most phrases occur in any part of the texts, so a part names them; the rest then looks for those still without words.
    first = F.pmod(F.xxhash64("codes"), F.lit(_SHARE)) == 0
    named = _named(batches.where(first), hashes, longest)
    unnamed = written(hashes.join(named.select("h"), "h", "left_anti"), "unnamed")
    named = named.union(_named(batches.where(~first), unnamed, longest))
    return named.select("lang", "phrase").distinct()


def _named(batches: DataFrame, hashes: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, h) of the windows in ``batches`` whose hash is in ``hashes``, of two words and more."""
    bitmap = _bitmap(hashes)
    named = _read_all(
        batches, _passing_phrases(bitmap, longest), "lang string, phrase string, h bigint",
        lambda x: x.distinct().join(hashes.distinct(), "h").select("lang", "phrase", "h"), "candidates",
    )
    bitmap.destroy()
    return named


# -- exact counts by double-array tries -----------------------------------------------


class DoubleArray:
    """A trie of symbol sequences: the child of state ``s`` by symbol ``c`` is ``base[s] + c`` if ``check`` there is ``s``.

    Symbols are positive, frequent ones best small; state 1 is the root; ``ends[i]`` is the state of
    the ``i``-th sequence.  Parents of many children are placed first, those of one child fill the gaps.
    """

    def __init__(self, sequences: list[list[int]]):
        longest = max(map(len, sequences), default=0)
        rows = np.zeros((len(sequences), longest), np.int32)
        for k, sequence in enumerate(sequences):
            rows[k, : len(sequence)] = sequence
        width = int(rows.max(initial=0)) + 1
        self.base, self.check = np.zeros(2 * width + 8, np.int32), np.full(2 * width + 8, -1, np.int32)
        self.check[:2] = 0
        self._gap, self._last = 2, 1
        states, self.ends = np.ones(len(sequences), np.int64), np.ones(len(sequences), np.int64)
        for depth in range(longest):
            on = np.flatnonzero(rows[:, depth])
            edges, place = np.unique(states[on] * width + rows[on, depth], return_inverse=True)
            children = self._placed(edges // width, edges % width)
            states[on] = self.ends[on] = children[place]
        self.base, self.check = self.base[: self._last + 1], self.check[: self._last + 1]

    def _placed(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States for the edges, which are sorted by parent."""
        children = np.zeros(len(parents), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(starts, len(parents)))
        lone = starts[sizes == 1]
        near, digits = 2, 0
        for at in np.argsort(-sizes, kind="stable")[: len(sizes) - len(lone)]:
            part = slice(starts[at], starts[at] + sizes[at])
            parent, own = int(parents[part.start]), symbols[part]
            if int(sizes[at]).bit_length() != digits:  # smaller families fit where larger ones did not
                near, digits = self._gap, int(sizes[at]).bit_length()
            base, near = self._fitting(own, near)
            self.base[parent], children[part] = base, base + own
            self.check[children[part]] = parent
            self._last = max(self._last, int(children[part][-1]))
        if len(lone):  # any free place does
            self._reach(self._last + len(lone) + 1)
            places = np.flatnonzero(self.check[self._gap :] < 0)[: len(lone)] + self._gap
            self.base[parents[lone]], self.check[places] = places - symbols[lone], parents[lone]
            children[lone] = places
            self._gap, self._last = int(places[-1]) + 1, max(self._last, int(places[-1]))
        return children

    def _fitting(self, symbols: np.ndarray, near: int) -> tuple[int, int]:
        """A base whose places for all the symbols are free, and where to look next; from place ``near`` on."""
        apart = symbols - symbols[0]
        while True:
            stop = near + max(32, (1 << 8) // len(symbols))
            self._reach(stop + int(apart[-1]))
            places = np.flatnonzero(self.check[near:stop] < 0) + near
            fits = np.flatnonzero((self.check[places[:, None] + apart] < 0).all(axis=1)) if len(places) else places
            if len(fits):
                return int(places[fits[0]]) - int(symbols[0]), near
            near = stop

    def _reach(self, place: int) -> None:
        if place >= len(self.check):
            more = place + len(self.check) // 2 + 1 - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])


def state_counts(
    base: np.ndarray, check: np.ndarray, start: int, symbols: np.ndarray, longest: int, counts: np.ndarray
) -> None:
    """Add to ``counts`` how often each state of two or more symbols is reached from ``start``.

    All positions of ``symbols`` (0: not in the trie) advance together, one symbol at a time.
    """
    at = np.flatnonzero(symbols)
    states = np.full(len(at), start, np.int64)
    for depth in range(longest):
        own = symbols[at]
        following = base[states] + own
        inside = (own > 0) & (following > 0) & (following < len(check))
        hit = np.flatnonzero(inside)
        hit = hit[check[following[hit]] == states[hit]]
        at, states = at[hit], following[hit]
        if depth:
            counts += np.bincount(states, minlength=len(counts))
        on = at + 1 < len(symbols)
        at, states = at[on] + 1, states[on].astype(np.int64)


_TRIE = "kind string, place bigint, lang string, phrase string, data binary"


def _build_trie(frame: pd.DataFrame) -> pd.DataFrame:
    """One block's double-array trie and the state of each phrase; a sequence is a language and its words."""
    phrases = [x.encode().split(b" ") for x in frame["phrase"]]
    langs = sorted(set(frame["lang"]))
    uses = Counter(w for p in phrases for w in p)
    words = sorted(uses, key=lambda w: (-uses[w], w))
    lang_symbols = {x: k for k, x in enumerate(langs, 1)}
    word_symbols = {x: k for k, x in enumerate(words, 1 + len(langs))}
    trie = DoubleArray([[lang_symbols[x], *map(word_symbols.__getitem__, p)] for x, p in zip(frame["lang"], phrases, strict=True)])
    parts = {"base": trie.base.tobytes(), "check": trie.check.tobytes(), "langs": json.dumps(langs).encode(), "words": b" ".join(words)}
    out = [(kind, 0, None, None, data) for kind, data in parts.items()]
    out += zip(["phrase"] * len(frame), trie.ends.tolist(), frame["lang"], frame["phrase"], [None] * len(frame), strict=True)
    return pd.DataFrame(out, columns=["kind", "place", "lang", "phrase", "data"])


def _trie_counts(trie, longest: int):
    """Rows (block, counts): how often the task's texts reach each state of the broadcast trie, ``_STATES`` to a row."""

    def run(frames):
        parts = trie.value
        base, check = (np.frombuffer(parts[x], np.int32) for x in ("base", "check"))
        langs = {x: k for k, x in enumerate(json.loads(parts["langs"]), 1)}
        symbols = {x: k for k, x in enumerate(parts["words"].split(b" "), 1 + len(langs))}
        counts = np.zeros(-(-len(check) // _STATES) * _STATES, np.int64)
        for frame in frames:
            for lang, words, codes in _read(frame):
                if lang in langs:
                    start = int(base[1]) + langs[lang]
                    own = np.array([0, *(symbols.get(w, 0) for w in words)], np.int64)
                    state_counts(base, check, start, own[codes], longest, counts)
        rows = counts.reshape(-1, _STATES)
        blocks = np.flatnonzero(rows.any(axis=1))
        if len(blocks):
            yield pd.DataFrame({"block": blocks, "counts": [rows[i].tobytes() for i in blocks]})

    return run


def _block_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (place, f) from blocks in order; one block's sum is held at a time."""
    block, total = -1, np.zeros(_STATES, np.int64)

    def rows() -> pd.DataFrame:
        places = np.flatnonzero(total)
        return pd.DataFrame({"place": block * _STATES + places, "f": total[places]})

    for frame in frames:
        for own, counts in zip(frame["block"].tolist(), frame["counts"], strict=True):
            if own != block and block >= 0:
                yield rows()
                total = np.zeros(_STATES, np.int64)
            block, total = own, total + np.frombuffer(counts, np.int64)
    if block >= 0:
        yield rows()


def exact_counts(batches: DataFrame, candidates: DataFrame, longest: int, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(lang, phrase, f) for each candidate, from one reading of the batches per block of candidates."""
    spark = batches.sparkSession
    blocks = max(1, -(-candidates.count() // block_phrases))
    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)).cast("int"))
    tries = written(dealt.groupBy("block").applyInPandas(lambda key, x: _build_trie(x).assign(block=key[0]), _TRIE + ", block int"), "tries")
    counted = None
    for block in range(blocks):
        own = tries.where(F.col("block") == block)
        parts = {r.kind: r.data for r in own.where("kind <> 'phrase'").collect()}  # one trie
        if not parts:
            continue
        trie = spark.sparkContext.broadcast({x: bytes(data) for x, data in parts.items()})
        sums = _read_all(
            batches, _trie_counts(trie, longest), "block bigint, counts binary",
            lambda x: x.repartition("block").sortWithinPartitions("block").mapInPandas(_block_sums, "place bigint, f bigint"),
            "state-counts",
        )
        part = own.where("kind = 'phrase'").join(sums, "place").select("lang", "phrase", "f")
        trie.destroy()
        counted = part if counted is None else counted.union(part)
    return counted if counted is not None else candidates.withColumn("f", F.lit(0).cast("bigint"))


# -- scores --------------------------------------------------------------------------


def _scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase with its lowest-scoring cut, (lang, phrase, a, l, r, n, score); ``counts`` holds all parts."""
    known = written(counts, "known-counts")
    split = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("w")).withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
    cuts = cuts.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")).drop("w")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(broadcast_if_small(written(totals, "word-totals"), _LANGS), "lang")
    whole = {x: F.col(x).cast("decimal(18,0)") for x in ("a", "l", "r", "n")}
    score = F.call_function("div", whole["a"] * F.lit(1000).cast("decimal(4,0)") * whole["n"], whole["l"] * whole["r"])
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    least = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest)
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase that holds the phrase."""
    spans = F.expr(
        "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    )
    parts = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), "f")
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, block_phrases: int = BLOCK_PHRASES
) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    ``a``: occurrences, ``n``: words of the language, ``l`` and ``r``: occurrences of the two parts at the
    cut with the lowest score, which is floor(1000 a n / (l r)).  A phrase that a longer one covers
    in every occurrence is left out.  Ties: larger ``a``, then the phrase in byte order.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with arrow_rows(docs.sparkSession, _TEXT_ROWS):
        batches = rows.mapInPandas(_batches, "lang string, vocabulary binary, codes binary, n_words bigint")
        batches = written(batches, "word-batches")
    totals = batches.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = _read_all(
        batches, _word_counts, "lang string, phrase string, f bigint",
        lambda x: x.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "frequent-words",
    )
    candidates = candidate_phrases(batches, words, min_count, longest)
    phrases = exact_counts(batches, candidates, longest, block_phrases).where(F.col("f") >= min_count)
    left = phrases.join(_covered(phrases), ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)) < F.col("f"))
    scored = _scored(left.select("lang", "phrase", "f"), phrases.unionByName(words), totals)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
