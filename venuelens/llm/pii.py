"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

Base spans are found by patterns with checks (e-mail, ip, card, phone).  They are the seed
entities.  Every token with a digit or an ``@`` is an instance.  Its patterns are the word before
it, the two words before, the word after, and its shape.  A few labels of secrets, such as ``token =``,
are seed patterns.  Spark keeps the pattern-instance graph as an edge table and scores it in rounds: a
pattern's score is the mean score of its instances (smoothed), an instance that is no seed gets the chance
that at least one of its supported patterns is right.  Instances above the threshold support
patterns in the next round as seeds do, so that finds lead to contexts that no seed has.
Instances that end above the threshold are added as spans of kind ``identifier``, if they have
``MIN_TOKEN`` letters or digits.  A token in the form of a card or an ip that the check refused is no
instance.  Only built-in functions are used; texts are never shuffled.

Edge cases: a null text counts as empty; an empty text has no spans; repeated rows get the
same spans each and count once in the graph; without seeds nothing is added but what a seed pattern finds.
Offsets count code points, ends are exclusive.  The possessive and ``\\G`` forms of the patterns
match the same spans as the plain ones but need no backtracking, and places of matches are summed in
chunks, so a text of any length costs about linear time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.session import written

ROUNDS = 3
#: An instance is added from this score on; a pattern counts from so many distinct seeds on.
MIN_SCORE = 0.6
MIN_SEEDS = 3
#: Letters and digits an added identifier must have.
MIN_TOKEN = 6
EXTRA = "identifier"
#: Tokens that a base pattern takes as a whole; without a span its check has refused them.
_DECIDED = r"^([0-9]{16,19}|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
#: Score of a seed pattern: a label of a secret and a sign before its value.
SEED_CONFIDENCE = 0.9
SEED_PATTERN = r"^l[12] (\S* )?(\S*[^a-z])?(password|passwd|secret|token|((api|access|private)[_-]?)?key)[\"']? ?[=:]+$"
#: Matches whose places are summed one after another; chunks of them are summed in a second step.
_CHUNK = 256

_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check, from the right every second doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    worth = F.transform(each, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_OCTET}(\.{_OCTET}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after) of all matches in ``text``, in code points.

    ``before``: the text back to the match before, with that match; ``after``: up to the next match.
    """
    empty = F.lit([]).cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")

    def parts(found: Column, gaps: Column) -> Column:
        previous = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.size(found) - 1))
        return F.arrays_zip(
            found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), previous.alias("previous"),
            F.slice(gaps, F.lit(2), F.size(found)).alias("after"),
        )

    def length(part: Column) -> Column:
        return (F.length(part["gap"]) + F.length(part["value"])).cast("bigint")

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        one = F.struct(
            begin.alias("start"), (state["at"] + length(part)).alias("end"), part["value"].alias("value"),
            F.concat(part["previous"], part["gap"]).alias("before"), part["after"].alias("after"),
        )
        return F.struct((state["at"] + length(part)).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def placed(chunk: Column, begin: Column) -> Column:
        return F.aggregate(chunk, F.struct(begin.alias("at"), empty.alias("out")), add, lambda s: s["out"])

    def begins(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + length(x)))
        first = F.array(F.lit(0).cast("bigint"))
        return F.aggregate(sizes, first, lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def cut(all_parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / _CHUNK).cast("int"))
        return F.transform(places, lambda c: F.slice(all_parts, c * _CHUNK + 1, F.lit(_CHUNK)))

    def summed(chunks: Column) -> Column:
        return F.flatten(F.zip_with(chunks, F.slice(begins(chunks), F.lit(1), F.size(chunks)), placed))

    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = _let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda x: parts(x["found"], x["gaps"]))
    return F.when(F.rlike(text, F.lit(pattern)), _let(both, lambda p: _let(cut(p), summed))).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) by kind as listed, then start."""
    return F.concat(*[_spans_of(text, kind) for kind in KINDS])


def _spans_of(text: Column, kind: str) -> Column:
    good = F.filter(_matches(text, KINDS[kind]), lambda m: _valid(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _covered(spans: Column, kind: str) -> Column:
    """A byte per code point up to the last span of the kind: ``1`` inside the spans, which are in order and apart."""
    own = F.filter(spans, lambda s: s["kind"] == kind)

    def mask(x: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(x["end"], F.lit(1), F.size(x) - 1))
        pieces = F.zip_with(
            x, ends, lambda s, e: F.concat(F.repeat(F.lit("0"), (s["start"] - e).cast("int")), F.repeat(F.lit("1"), (s["end"] - s["start"]).cast("int")))
        )
        return F.array_join(pieces, "").cast("binary")

    return F.when(F.size(own) > 0, _let(own, mask)).otherwise(F.lit("").cast("binary"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def _shape(core: Column) -> Column:
    """Digits and hexadecimal digits by their number, other tokens by their runs of letters and digits."""
    runs = F.regexp_replace(F.regexp_replace(core, r"\p{L}+", "a"), r"\p{N}+", "0")
    return (
        F.when(F.rlike(core, F.lit(r"^[0-9]+$")), F.concat(F.lit("digits "), F.length(core)))
        .when(F.rlike(core, F.lit(r"^[0-9a-f]+$")), F.concat(F.lit("hex "), F.length(core)))
        .otherwise(runs)
    )


def _tokens(text: Column, spans: Column) -> Column:
    """Identifier-like tokens: bounds without outer punctuation, the token, its patterns, and whether a span meets it."""

    def patterns(core: Column, left: Column, right: Column) -> Column:
        one, two = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
        named = {"l1 ": one, "l2 ": F.concat(two, F.lit(" "), one), "r1 ": F.get(right, F.lit(0)), "s ": _shape(core)}
        return F.array_compact(F.array(*[F.concat(F.lit(k), v) for k, v in named.items()]))

    def describe(m: Column, masks: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}]*", 0))
        core = F.regexp_replace(m["value"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        begin = m["start"] + lead
        inside = [
            F.contains(F.substring(masks[k], (m["start"] + 1).cast("int"), F.length(m["value"])), F.lit("1").cast("binary")) for k in KINDS
        ]
        seed = reduce(or_, inside)
        return F.struct(
            begin.alias("start"), (begin + F.length(core)).alias("end"), F.xxhash64(core).alias("instance"),
            F.length(F.regexp_replace(core, r"[^\p{L}\p{N}]", "")).alias("size"),
            patterns(core, _words(m["before"]), _words(m["after"])).alias("patterns"), seed.alias("seed"),
            (~seed & F.rlike(core, F.lit(_DECIDED))).alias("refused"),
        )

    masks = F.struct(*[_covered(spans, k).alias(k) for k in KINDS])
    return _let(masks, lambda x: F.transform(_matches(text, _TOKEN), lambda m: describe(m, x)))


def instance_scores(
    edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE
) -> DataFrame:
    """(instance, score) of the instances that are no seeds, from edges (pattern, instance, seed)."""
    own = F.when(F.col("seed"), 1.0)
    scored = edges.select("pattern", "instance", "seed", own.otherwise(0.0).alias("score"))
    for _ in range(rounds):
        mean = F.sum("score") / (F.count("*") + 1)
        labels = F.rlike(F.col("pattern"), F.lit(SEED_PATTERN))
        patterns = scored.groupBy("pattern").agg(mean.alias("mean"), F.count_if(F.col("score") >= min_score).alias("support"))
        patterns = patterns.where(labels | (F.col("support") >= min_seeds)).select(
            "pattern", F.when(labels, F.greatest("mean", F.lit(SEED_CONFIDENCE))).otherwise(F.col("mean")).alias("p")
        )
        # Written, so that both sides of the join are plain shuffles, whose hot keys adaptive execution splits.
        patterns = written(patterns, "pii-patterns")
        lifted = edges.where(~F.col("seed")).join(patterns, "pattern").groupBy("instance")
        lifted = written(lifted.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("score")), "pii-scores")
        fresh = edges.join(lifted, "instance", "left")
        scored = fresh.select("pattern", "instance", "seed", own.otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
    return lifted


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(doc_id, base, extra) per row: arrays of (kind, start, end), each in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    found = rows.select("doc_id", "mark", "base", _tokens(F.col("text"), F.col("base")).alias("tokens"))
    found = written(found, "pii-found")
    tokens = found.select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.*").where("not refused")
    edges = tokens.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = written(edges.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed")), "pii-edges")
    good = instance_scores(edges, rounds, min_seeds, min_score).where(F.col("score") >= min_score).select("instance")
    extra = tokens.where(~F.col("seed") & (F.col("size") >= MIN_TOKEN)).join(good, "instance")
    span = F.struct(F.col("start"), F.col("end"))
    extra = extra.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.array_sort(F.collect_set(span)).alias("more"))
    out = found.join(extra, found["doc_id"].eqNullSafe(extra["d"]) & (found["mark"] == extra["m"]), "left")
    named = F.transform("more", lambda s: F.struct(F.lit(EXTRA).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "base", F.coalesce(named, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("extra"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
