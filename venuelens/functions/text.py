"""Text splitting as column expressions: no UDF, no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns that results depend on ---------------------------
# The whitespace of Unicode-aware text: the White_Space property and the four
# information separators.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"([a-zA-Z']+)"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Sentences end at whitespace after one of three marks.
_BREAK = rf"(?U)(?<=[.!?]){SPACE}+"
# --- end of fixed values -----------------------------------------------------

#: The characters of ``SPACE``, one by one.
_SPACES = "".join(
    map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_GAP = rf"(?U){SPACE}+"
_PUNCT = "".join("\\" + c for c in ASCII_PUNCTUATION)
_INNER = rf"[^{_PUNCT}\s\x1c-\x1f]"
_ANY = r"[^\s\x1c-\x1f]"
_WRAPPED = rf"(?U)(?<!{_ANY})[{_PUNCT}]*+({_INNER}{_ANY}+{_INNER})[{_PUNCT}]*+(?!{_ANY})"


def strip(col: Column) -> Column:
    """No whitespace at either end; reads no further than that, where a pattern would try every character."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(_SPACES))


def has_text(col: Column) -> Column:
    """Anything but whitespace in the text; stops at the first such character."""
    return F.coalesce(F.rlike(col, F.lit(rf"(?U){_ANY}")), F.lit(False))


def sentence_array(text: Column) -> Column:
    """Non-empty sentences: split at whitespace that follows ``.``, ``!`` or ``?``."""
    return F.filter(F.split(strip(text), _BREAK), lambda s: s != "")


def word_array(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def spaced_tokens(sentence: Column) -> Column:
    """Whitespace tokens of a sentence that carries no outer whitespace."""
    return F.split(sentence, _GAP)


def spaced_token_count(sentence: Column) -> Column:
    return F.size(spaced_tokens(sentence))


def has_tokens(sentence: Column, n: int) -> Column:
    """At least ``n`` whitespace tokens in a sentence that carries no outer whitespace;
    reads no further than the ``n``-th."""
    return F.rlike(sentence, F.lit(rf"(?U)\A(?:{_ANY}++{SPACE}++){{{n - 1}}}{_ANY}"))


def without_outer_punctuation(sentence: Column) -> Column:
    """The sentence with outer punctuation cut from each whitespace token, unless at most
    two characters of the token would remain.

    One pass over the sentence: a function per token would cost several times as much.
    """
    return F.regexp_replace(sentence, _WRAPPED, "$1")


def bare_token(token: Column) -> Column:
    """One whitespace token without its outer punctuation, by the rule of ``without_outer_punctuation``.

    For rows of exploded tokens: two looks at the ends, where a pattern reads every character.
    """
    core = F.btrim(token, F.lit(ASCII_PUNCTUATION))
    # Trimming copies every character it looks at, so most words are spared by their first and last one.
    ends = F.substring(token, 1, 1).isin(*ASCII_PUNCTUATION) | F.substring(token, -1, 1).isin(*ASCII_PUNCTUATION)
    return F.when(ends, F.when(F.length(core) > 2, core).otherwise(token)).otherwise(token)


def holds_token(sentence: Column, token: str) -> Column:
    """Some whitespace token of ``sentence`` is ``token``, perhaps in outer punctuation."""
    return F.rlike(sentence, F.lit(rf"(?U)(?<!{_ANY})[{_PUNCT}]*\Q{token}\E[{_PUNCT}]*(?!{_ANY})"))


def windows(text: Column, size: int) -> Column:
    """The whole text in windows of ``size`` characters, cut in one pass; an empty text is one empty window."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) > 0, cut).otherwise(F.array(F.lit("")))


_SPAN = 2**31


def _span() -> Column:
    return F.lit(_SPAN).cast("decimal(10,0)")


def position(review_id: Column, offset: Column, text_key: bool = False) -> Column:
    """``(review_id, offset)`` as one number that sorts the same way.

    A fixed-width number keeps ``min(position)`` in hash aggregation, where a struct
    would force a sort of all rows.  A key that is text needs the struct.
    """
    if text_key:
        return F.struct(review_id.alias("review_id"), offset.alias("offset"))
    base = (review_id.cast("decimal(19,0)") * _span()).cast("decimal(30,0)")
    return (base + offset.cast("decimal(10,0)")).cast("decimal(30,0)")


def narrow_position(review_id: Column, offset: Column) -> Column:
    """The same number as a long, for ids from -2**32 to 2**32 - 1."""
    return review_id.cast("bigint") * F.lit(_SPAN).cast("bigint") + offset.cast("bigint")


def position_offset(pos: Column, text_key: bool = False) -> Column:
    if text_key:
        return pos["offset"]
    return F.pmod(pos, _span()).cast("int")


def position_review(pos: Column, text_key: bool = False) -> Column:
    if text_key:
        return pos["review_id"]
    return ((pos - F.pmod(pos, _span())) / _span()).cast("bigint")
