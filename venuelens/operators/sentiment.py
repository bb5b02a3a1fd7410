"""Lexicon sentiment of sentences as a join against a valence table.

The lexicon is the caller's: ``(token, valence)``, tokens in lower case and unique.  No
word list of any sentiment package is shipped.  The rules follow the published
description of a rule-based lexicon scorer (Hutto & Gilbert, ICWSM 2014).

Idioms and emoji are the caller's as well.  Words that form a phrase of the table
``(phrase, valence)`` count as one word with that valence: matches are by whole words in any case, from
left to right, the longest first, and do not overlap.  A symbol of the table ``(symbol, description)``
is read as the words that describe it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.functions import text as X
from venuelens.functions.rounding import exact_round
from venuelens.functions.scores import signed_score
from venuelens.session import broadcast_if_small

# --- fixed values: degree words, negations and factors of the published rules --
STRENGTHENERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply enormously "
    "entirely especially exceptionally extremely fabulously fully greatly highly hugely "
    "incredibly intensely majorly more most particularly purely quite really remarkably so "
    "substantially thoroughly totally tremendously unbelievably unusually utterly very"
).split()
WEAKENERS = (
    "almost barely hardly kinda kindof less little marginally occasionally partly scarcely "
    "slightly somewhat sorta"
).split()
NEGATORS = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt "
    "mustnt neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt "
    "uhuh wasnt werent without wont wouldnt rarely seldom despite"
).split()
STEP = 0.293
# --- end of fixed values -------------------------------------------------------


@dataclass(frozen=True)
class SentimentRules:
    """Parameters of the modifier rules."""

    boosters: dict[str, float] = field(
        default_factory=lambda: {w: STEP for w in STRENGTHENERS} | {w: -STEP for w in WEAKENERS}
    )
    negators: tuple[str, ...] = tuple(NEGATORS)
    negation_mark: str = "n't"
    contrast: str = "but"
    capitals: float = 0.733
    negation: float = -0.74
    never_so: float = 1.25
    damping: tuple[float, ...] = (1.0, 0.95, 0.9)
    before_contrast: float = 0.5
    after_contrast: float = 1.5
    exclamation: float = 0.292
    exclamations: int = 4
    question: float = 0.18
    questions: int = 3
    many_questions: float = 0.96
    alpha: float = 15.0


DEFAULT_RULES = SentimentRules()

KEYS = ["review_id", "sent_pos"]

#: A lexicon up to this size is broadcast (some 50 MB); a larger one is joined by shuffle.
MAX_BROADCAST_TOKENS = 500_000


#: Phrases, and symbols, that a table may hold: they become part of the plan.
MAX_PHRASES = 20_000


def _bounded(table: DataFrame, columns: list[str]) -> list[tuple]:
    rows = table.select(*columns).dropna().distinct().limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} rows of {columns}")
    return [tuple(r) for r in rows]


def normal_phrases(phrases: DataFrame) -> DataFrame:
    """``(token, valence)``: phrases in lower case with single blanks, as the merged tokens are written."""
    words = F.array_join(X.spaced_tokens(X.strip(F.lower("phrase"))), " ")
    return phrases.select(words.alias("token"), F.col("valence").cast("double").alias("valence")).where("token <> ''")


def describe_symbols(sentence: Column, names: dict[str, str]) -> Column:
    """The text with each symbol of ``names`` read as its description, a word of its own; the longest symbol first."""
    if not names:
        return sentence
    symbols = sorted(names, key=lambda x: (-len(x), x))
    first = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted({x[0] for x in symbols})) + "]"
    any_symbol = f"(?={first})(?:{'|'.join(''.join(f'\\x{{{ord(c):x}}}' for c in x) for x in symbols)})"
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    tokens = X.spaced_tokens(X.strip(F.regexp_replace(sentence, any_symbol, " $0 ")))
    named = F.transform(tokens, lambda t: F.when(t.isin(symbols), F.element_at(table, t)).otherwise(t))
    return F.when(F.rlike(sentence, F.lit(first)), X.strip(F.array_join(named, " "))).otherwise(sentence)


def merge_phrases(tokens: Column, lows: Column, phrases: list[str]) -> Column:
    """``tokens`` with the words of each phrase put together, blanks between them; ``lows`` are they in lower case.

    Only tokens that begin some phrase are looked up, by a hash of first words, so the rest of a
    sentence costs one lookup a token, whatever the number of phrases.
    """
    by_first: dict[str, list[list[str]]] = {}
    for words in sorted(p.split(" ") for p in set(phrases)):
        if len(words) > 1:
            by_first.setdefault(words[0], []).append(words)
    if not by_first:
        return tokens
    table = F.from_json(F.lit(json.dumps(by_first)), "map<string,array<array<string>>>")
    starts = F.filter(
        F.transform(lows, lambda t, i: F.struct(i.alias("at"), t.alias("first"))), lambda h: h["first"].isin(list(by_first))
    )

    def longest(h: Column) -> Column:
        held = F.filter(F.element_at(table, h["first"]), lambda p: F.slice(lows, h["at"] + 1, F.size(p)) == p)
        return F.coalesce(F.array_max(F.transform(held, lambda p: F.size(p))), F.lit(0))

    def step(done: Column, h: Column) -> Column:
        one = F.array_join(F.slice(tokens, h["at"] + 1, h["n"]), " ")
        skipped = F.slice(tokens, done["end"] + 1, h["at"] - done["end"])
        taken = F.struct((h["at"] + h["n"]).alias("end"), F.concat(done["out"], skipped, F.array(one)).alias("out"))
        return F.when(h["at"] >= done["end"], taken).otherwise(done)

    found = F.filter(
        F.transform(starts, lambda h: F.struct(h["at"].alias("at"), longest(h).alias("n"))), lambda h: h["n"] > 0
    )
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(
        found, none, step, lambda done: F.concat(done["out"], F.slice(tokens, done["end"] + 1, F.size(tokens) - done["end"]))
    )
    return F.when(F.size(starts) > 0, rest).otherwise(tokens)


def _is_upper(token: Column) -> Column:
    # Most words are in lower case, and need no second look.
    return (token != F.lower(token)) & (token == F.upper(token))


def _count_char(sentence: Column, char: str) -> Column:
    return F.length(sentence) - F.length(F.replace(sentence, F.lit(char), F.lit("")))


def punctuation_emphasis(sentence: Column, rules: SentimentRules) -> Column:
    marks = F.least(_count_char(sentence, "!"), F.lit(rules.exclamations))
    asked = _count_char(sentence, "?")
    questions = (
        F.when(asked <= 1, F.lit(0.0))
        .when(asked <= rules.questions, asked * F.lit(rules.question))
        .otherwise(F.lit(rules.many_questions))
    )
    return marks * F.lit(rules.exclamation) + questions


def with_compound(
    totals: DataFrame, carry: list[str], alpha: float = DEFAULT_RULES.alpha
) -> DataFrame:
    """Valence sums ``total`` squeezed into [-1, 1] as ``compound``, four decimals."""
    total = F.col("total")
    squeezed = total / F.sqrt(total * total + F.lit(alpha))
    return totals.select(
        *KEYS, *carry, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), squeezed)).alias("squeezed")
    ).select(*KEYS, *carry, exact_round(F.col("squeezed"), 4).alias("compound"))


def _with_tokens(
    sentences: DataFrame, carry: list[str], phrases: list[str]
) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``tokens`` of each sentence, phrases as one token, and the function that gives a token as it is scored.

    Without phrases the tokens keep their outer punctuation until they are rows of their own: only there
    is cutting it cheap.
    """
    if not phrases:
        return sentences.select(*KEYS, *carry, "sentence", X.spaced_tokens(F.col("sentence")).alias("tokens")), X.bare_token
    bare = X.without_outer_punctuation(F.col("sentence"))
    # Lower case does not depend on what stands beyond a blank, so one split gives both arrays.
    cut = sentences.select(*KEYS, *carry, "sentence", X.spaced_tokens(bare).alias("tokens")).select(
        *KEYS, *carry, "sentence", "tokens", F.transform("tokens", F.lower).alias("lows")
    )
    return cut.withColumn("tokens", merge_phrases(F.col("tokens"), F.col("lows"), phrases)).drop("lows"), lambda t: t


def score_core(sentences: DataFrame, lexicon: DataFrame, carry: list[str], phrases: list[str]) -> DataFrame:
    """Sum of the valences of known tokens, normalised; no modifier rule."""
    cut, as_scored = _with_tokens(sentences, carry, phrases)
    raw = cut.select(*KEYS, *carry, F.explode("tokens").alias("raw"))
    exploded = raw.select(*KEYS, *carry, F.lower(as_scored(F.col("raw"))).alias("token"))
    totals = (
        exploded.join(lexicon, "token", "left")
        .groupBy(*KEYS, *carry)
        .agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("total"))
    )
    return with_compound(totals, carry)


def _booster(token: Column, boosters: dict[str, float]) -> Column:
    scalar = F.lit(0.0)
    for value in sorted(set(boosters.values())):
        listed = [w for w, v in boosters.items() if v == value]
        scalar = F.when(token.isin(*listed), F.lit(value)).otherwise(scalar)
    return scalar


def _flip(value: Column, toward: Column) -> Column:
    """``value`` with its sign turned when ``toward`` is negative."""
    return F.when(toward < 0, -value).otherwise(value)


def _away_from_zero(value: Column, amount: float, sign_of: Column) -> Column:
    return F.when(sign_of > 0, value + F.lit(amount)).otherwise(value - F.lit(amount))


def _negates(token: Column, rules: SentimentRules) -> Column:
    return token.isin(*rules.negators) | F.contains(token, F.lit(rules.negation_mark))


def _is_cue(token: Column, rules: SentimentRules) -> Column:
    """Any word that may change the valence of a word after it."""
    return F.coalesce(token.isin(*rules.boosters, "never", "without") | _negates(token, rules), F.lit(False))


def _turn(distance: int, rules: SentimentRules) -> Column:
    """The factor of the word ``distance`` places back: "never so" and "never this" lift,
    "without doubt" leaves as it is, other negations turn."""
    word, nearer = F.col(f"cue{distance}"), [F.lower(f"raw{d}") for d in range(1, distance)]
    turn = F.when(_negates(word, rules), F.lit(rules.negation)).otherwise(F.lit(1.0))
    if nearer:
        follows = [reduce(or_, [F.coalesce(n.isin(*w), F.lit(False)) for n in nearer]) for w in (["so", "this"], ["doubt"])]
        turn = (
            F.when((word == "never") & follows[0], F.lit(rules.never_so))
            .when((word == "without") & follows[1], F.lit(1.0))
            .otherwise(turn)
        )
    return turn


def _has_no_before() -> Column:
    """A "no" one or two places back, or three back before "or" and "nor"."""
    one, two, three = (F.lower(f"raw{d}") for d in (1, 2, 3))
    return F.coalesce(one == "no", F.lit(False)) | F.coalesce(two == "no", F.lit(False)) | F.coalesce(
        (three == "no") & one.isin("or", "nor"), F.lit(False)
    )


def _after_cue(value: Column, cue: Column, rules: SentimentRules) -> Column:
    """A valence after one preceding word: lifted by a degree word, turned by a negation."""
    boost = _booster(cue["word"], rules.boosters)
    scalar = _flip(boost, value)
    loud = F.when(cue["loud"], _away_from_zero(scalar, rules.capitals, value)).otherwise(scalar)
    lifted = value + F.when(boost != 0, loud * cue["damping"]).otherwise(F.lit(0.0))
    return F.when(cue["word"].isNotNull() & cue["plain"], lifted * cue["turn"]).otherwise(value)


def score_with_modifiers(
    sentences: DataFrame, lexicon: DataFrame, rules: SentimentRules, carry: list[str], phrases: list[str]
) -> DataFrame:
    """All modifier rules, without a sort.

    Each token is exploded, and sentiment words get their three predecessors from the
    token array of their own row; so the look-back needs no window.  Whether a predecessor
    is itself a sentiment word only matters for degree words and negations, hence the
    small table of cue words.
    """
    distances = range(1, len(rules.damping) + 1)
    facts = ["emphasis", "contrast_at"]
    cut, as_scored = _with_tokens(sentences, carry, phrases)
    # Only a sentence with the letters of the contrast word can hold it.
    lowered = F.lower("sentence")
    may_contrast = F.contains(lowered, F.lit(rules.contrast)) & (
        F.lit(True) if phrases else X.holds_token(lowered, rules.contrast)
    )
    contrast_at = F.when(
        may_contrast,
        F.array_position(F.transform("tokens", lambda t: F.lower(as_scored(t))), rules.contrast) - F.lit(1),
    ).otherwise(F.lit(-1).cast("bigint"))
    per_sentence = cut.select(
        *KEYS,
        *carry,
        punctuation_emphasis(F.col("sentence"), rules).alias("emphasis"),
        contrast_at.alias("contrast_at"),
        "tokens",
    )
    exploded = per_sentence.select(
        *KEYS, *carry, *facts, "tokens",
        # outer, although no sentence is empty: the inner form would add a filter on the
        # token count, which cuts every sentence a second time
        F.posexplode_outer("tokens").alias("at", "written"),
    ).select(*KEYS, *carry, *facts, "tokens", "at", as_scored(F.col("written")).alias("raw")).withColumn("token", F.lower("raw"))
    # Other words add nothing to the sum; the first of each sentence stays, for sentences without a known word.
    worth = F.col("valence").isNotNull() | (F.coalesce("at", F.lit(0)) == 0)
    row = exploded.join(lexicon, "token", "left").where(worth).select(
        *KEYS, *carry, *facts, "tokens", "at", "raw", "token", "valence",
        *[as_scored(F.get("tokens", F.col("at") - F.lit(d))).alias(f"raw{d}") for d in distances],
        F.when(F.col("token") == "no", F.lower(as_scored(F.get("tokens", F.col("at") + F.lit(1))))).alias("after_no"),
    )
    # Only capitals of a sentiment word or a degree word matter: the rest of the sentence is looked at where one has them.
    degree = [F.lower(f"raw{d}").isin(*rules.boosters) & _is_upper(F.col(f"raw{d}")) for d in distances]
    loud = reduce(or_, [F.coalesce(c, F.lit(False)) for c in [_is_upper(F.col("raw")), *degree]])
    row = row.withColumn("tokens", F.when(F.col("valence").isNotNull() & loud, F.col("tokens")))
    mixed = F.exists("tokens", _is_upper) & F.exists("tokens", lambda t: ~_is_upper(t))
    row = row.withColumn("mixed", F.coalesce(mixed, F.lit(False))).drop("tokens")
    known = broadcast_if_small(
        lexicon.filter(
            F.col("token").isin(*rules.boosters, "least", "never", "without") | _negates(F.col("token"), rules)
        ),
        MAX_BROADCAST_TOKENS,
    )
    for d in distances:
        # only sentiment words look back
        seen = F.when(F.col("valence").isNotNull(), F.lower(f"raw{d}"))
        cue = known.select(F.col("token").alias(f"cue{d}"), F.lit(True).alias(f"known{d}"))
        row = row.withColumn(f"cue{d}", seen).join(cue, f"cue{d}", "left")

    # "no" before a sentiment word has no valence of its own; only "no" looks ahead
    ahead = lexicon.select(F.col("token").alias("after_no"), F.lit(True).alias("is_cue"))
    row = row.join(ahead, "after_no", "left")

    # One fold over the cues, worked out for sentiment words only.  Written out as
    # columns, the steps would make the generated method too long to be compiled.
    cues = F.array(
        *[
            F.struct(
                F.col(f"cue{d}").alias("word"),
                F.col(f"known{d}").isNull().alias("plain"),
                (F.col("mixed") & _is_upper(F.col(f"raw{d}"))).alias("loud"),
                F.lit(damping).alias("damping"),
                _turn(d, rules).alias("turn"),
            )
            for d, damping in enumerate(rules.damping, start=1)
        ]
    )
    valence = (
        F.when(_has_no_before(), F.col("valence") * F.lit(rules.negation))
        .when(F.col("is_cue"), F.lit(0.0))
        .otherwise(F.col("valence"))
    )
    shouted = F.col("mixed") & _is_upper(F.col("raw"))
    start = F.when(shouted, _away_from_zero(valence, rules.capitals, valence)).otherwise(valence)
    least = (F.col("cue1") == "least") & F.col("known1").isNull() & ~F.coalesce(F.lower("raw2").isin("at", "very"), F.lit(False))
    is_booster = F.col("token").isin(*rules.boosters)
    counted = F.when(
        F.col("valence").isNotNull() & ~is_booster,
        F.when(
            reduce(or_, [_is_cue(F.col(f"cue{d}"), rules) for d in distances]),
            F.aggregate(cues, start, lambda value, cue: _after_cue(value, cue, rules)),
        ).otherwise(start)
        * F.when(least, F.lit(rules.negation)).otherwise(F.lit(1.0)),
    ).otherwise(F.lit(0.0))
    row = row.select(*KEYS, *carry, "emphasis", "at", "contrast_at", counted.alias("counted"))
    counted = F.col("counted")
    at, contrast_at = F.col("at"), F.col("contrast_at")
    weighted = (
        F.when((contrast_at >= 0) & (at < contrast_at), counted * F.lit(rules.before_contrast))
        .when((contrast_at >= 0) & (at > contrast_at), counted * F.lit(rules.after_contrast))
        .otherwise(counted)
    )
    total, emphasis = F.col("total"), F.col("emphasis")
    signed = (
        F.when(total > 0, total + emphasis).when(total < 0, total - emphasis).otherwise(total)
    )
    totals = row.groupBy(*KEYS, *carry, "emphasis").agg(F.sum(weighted).alias("total"))
    return with_compound(totals.withColumn("total", signed), carry, rules.alpha)


def score_sentences(
    sentences: DataFrame,
    lexicon: DataFrame | None = None,
    rules: SentimentRules | None = DEFAULT_RULES,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    carry: list[str] | None = None,
    phrases: DataFrame | None = None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """``compound`` in [-1, 1] per sentence, keyed by ``(review_id, sent_pos)``.

    ``carry`` names columns to keep (by default every input column but the text).
    ``rules=None`` leaves the modifier rules out.  ``scorer`` replaces the lexicon by a
    function that adds ``compound`` to a frame with a ``sentence`` column.  ``phrases`` (phrase,
    valence) and ``symbols`` (symbol, description) hold idioms and emoji, at most ``MAX_PHRASES`` each;
    phrases are unique but for case and blanks.
    """
    kept = [c for c in sentences.columns if c not in KEYS and c != "sentence"]
    carry = kept if carry is None else carry
    if scorer is not None:
        return scorer(sentences).select(*KEYS, *carry, "compound")
    if lexicon is None:
        raise ValueError("give a lexicon or a scorer")
    lexicon = lexicon.select("token", "valence")
    listed: list[str] = []
    if symbols is not None:
        names = {s: d for s, d in sorted(_bounded(symbols, ["symbol", "description"])) if s}
        sentences = sentences.withColumn("sentence", describe_symbols(F.col("sentence"), names))
    if phrases is not None:
        valences = dict(sorted(_bounded(normal_phrases(phrases), ["token", "valence"])))
        listed = list(valences)
        own = sentences.sparkSession.createDataFrame(list(valences.items()), "token string, valence double")
        lexicon = lexicon.join(F.broadcast(own), "token", "left_anti").unionByName(own)
    lexicon = broadcast_if_small(lexicon, MAX_BROADCAST_TOKENS)
    if rules is None:
        return score_core(sentences, lexicon, carry, listed)
    return score_with_modifiers(sentences, lexicon, rules, carry, listed)


def score_texts(reviews: DataFrame, lexicon: DataFrame | None = None, **options) -> DataFrame:
    """``compound`` of each whole text, taken as one sentence."""
    whole = reviews.select(
        "cafe_id",
        "review_id",
        F.lit(0).alias("sent_pos"),
        X.strip(F.col("review_text")).alias("sentence"),
    )
    return score_sentences(whole, lexicon, **options).drop("sent_pos")


def classifier_scorer(
    classify: Callable[[Column], Column], window: int = 512
) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a column function that returns ``struct<label, score>``.

    ``classify`` is usually a pandas UDF around a model; it is given every window of
    ``window`` characters in turn, the most such models take.  The window with the strongest
    score decides, the first of equals; ``guess`` is its label and score.
    """

    def score(sentences: DataFrame) -> DataFrame:
        rest = sentences.columns
        parts = sentences.select(
            *rest, F.posexplode(X.windows(F.coalesce("sentence", F.lit("")), window)).alias("window_no", "window_text")
        )
        guessed = parts.withColumn("guess", classify(F.col("window_text")))
        others = [c for c in rest if c not in ("review_id", "sent_pos")]
        best = F.max_by("guess", F.struct(F.col("guess.score"), -F.col("window_no"))).alias("guess")
        return (
            guessed.groupBy("review_id", "sent_pos")
            .agg(*[F.first(c).alias(c) for c in others], best)
            .withColumn("compound", signed_score(F.col("guess.label"), F.col("guess.score")))
        )

    return score
