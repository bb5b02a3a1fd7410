"""Registered queries: each operator over its whole table, in the fixed result form."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.llm import (
    audit,
    collocations,
    decontaminate,
    language,
    licenses,
    lines,
    nearest,
    packing,
    pii,
    quality,
    simhash,
    tokencounts,
    toxicity,
)
from venuelens.llm.common import crc_rest, table
from venuelens.session import shared_folder

#: A document is taken as class 1 from this score on.
THRESHOLD = 0.7
#: A text of more tokens is over the limit.
TOKEN_LIMIT = 512


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _scored(docs: DataFrame, held_out, score) -> DataFrame:
    out = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, held_out = table(spark, d, "documents"), crc_rest(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, d, "labels"), ~held_out)
    return _scored(docs, held_out, quality.quality_score(F.col("text"), model))


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, held_out = table(spark, d, "documents"), crc_rest(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, d, "labels"), ~held_out)
    return _scored(docs, held_out, toxicity.toxicity_score(F.col("text"), model))


def op3_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, d, "documents"), licenses.known_licenses(spark))


def op4_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, d, "documents"))
    counts = [pii.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("bigint").alias("n_identifier"),
    )


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    print_hex = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", print_hex, "component_id")


def op6_language(spark: SparkSession, d: str) -> DataFrame:
    docs, held_out = table(spark, d, "documents"), crc_rest(F.col("doc_id"), 5) == 0
    model = language.train(docs, ~held_out)
    out = docs.select("doc_id", held_out.alias("held_out"), language.predict_language(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack(table(spark, d, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents"))


def op13_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The cache belongs to the folder of the tables: a second run over the same tables finds its counts stored."""
    cache = f"{shared_folder(spark).rstrip('/')}/token-counts/{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    counted = tokencounts.token_counts(table(spark, d, "documents"), tokenizer_path(), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_nearest": op7_nearest,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_lines": op10_lines,
    "op11_audit": op11_audit,
    "op12_collocations": op12_collocations,
    "op13_tokens": op13_tokens,
}

_OP10_SQL = r"""
with lines as (
  select doc_id, u.pos, u.line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d,
    lateral (select unnest(parts) as line, generate_subscripts(parts, 1) as pos) u
),
shared as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
),
marked as (
  select l.*, s.key is not null and l.doc_id <> s.keeper as lost from lines l left join shared s on l.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from marked group by doc_id
"""

_OP11_SQL = r"""
with recursive read as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
),
firsts as (select text, min(doc_id) as least from read group by text),
marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
),
failed as (
  select r.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
    (case when len(words) < 200 then 1 else 0 end)
    + (case when 100 * list_unique(words) < 50 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(r.text, '[^A-Z]', '', 'g')) > 2 * length(r.text) then 4 else 0 end)
    + (case when regexp_matches(r.text, '[#$%&*|]') then 8 else 0 end)
    + (case when r.doc_id > f.least then 16 else 0 end) as mask
  from read r join firsts f on r.text = f.text left join marks m on r.doc_id = m.doc_id
),
cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, mask
),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(letter, bit)),
orders as (
  select letter as path, bit as used from letters
  union all
  select path || letter, used + bit from orders join letters on (used & bit) = 0
),
steps as (
  select path as filter_order, i as step, substr(path, i, 1) as letter, l.bit,
    coalesce((select sum(b.bit) from letters b where contains(substr(path, 1, i - 1), b.letter)), 0)::bigint as applied
  from orders, range(1, 6) r(i), letters l where length(path) = 5 and l.letter = substr(path, i, 1)
),
counted as (
  select c.part, s.filter_order, s.step, s.letter,
    coalesce(sum(n) filter ((mask & (applied | bit)) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter ((mask & bit) <> 0 and (mask & applied) = 0), 0)::bigint as removed,
    coalesce(sum(n) filter ((mask & bit) <> 0 and (mask & applied) <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter ((mask & bit) <> 0 and (mask & applied) = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter ((mask & bit) <> 0 and (mask & applied) = 0), 0)::bigint as toxic_lost
  from steps s cross join cells c group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from counted
"""
_OP12_SQL = r"""
with pieces as (
  select lang, piece, row_number() over () as place
  from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
  )
),
words as (
  select lang, place, pos, word from (
    select lang, place, unnest(w) as word, unnest(range(len(w))) as pos
    from (select *, string_split_regex(piece, '[\x20\x09]+') as w from pieces)
  ) where word <> ''
),
rows as (
  select lang, word as w1, lead(word, 1) over p as w2, lead(word, 2) over p as w3, lead(word, 3) over p as w4,
    lead(word, 4) over p as w5
  from words window p as (partition by place order by pos)
),
counts as (
  select lang, k, phrase, count(*) as f
  from (
    select lang, 1 as k, w1 as phrase from rows
    union all select lang, 2, w1 || ' ' || w2 from rows
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from rows
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from rows
    union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from rows
  )
  where phrase is not null group by lang, k, phrase
),
totals as (select lang, sum(f) as n from counts where k = 1 group by lang),
frequent as (select *, string_split(phrase, ' ') as w from counts where f >= 100),
covered as (
  select lang, part, max(f) as longer
  from (
    select lang, f, array_to_string(w[i:i + m - 1], ' ') as part
    from (select *, unnest(range(1, k - m + 2)) as i from frequent, range(2, 5) r(m) where m < k)
  )
  group by lang, part
),
cuts as (
  select c.lang, c.phrase, c.f as a, p.f as l, q.f as r, t.n, c.cut,
    (1000::hugeint * c.f::hugeint * t.n::hugeint) // (p.f::hugeint * q.f::hugeint) as score
  from (select *, unnest(range(1, k)) as cut from frequent where k > 1) c
  join counts p on p.lang = c.lang and p.phrase = array_to_string(c.w[1:cut], ' ')
  join counts q on q.lang = c.lang and q.phrase = array_to_string(c.w[cut + 1:], ' ')
  join totals t on t.lang = c.lang
),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
),
ranked as (
  select l.*, row_number() over (partition by l.lang order by score desc, a desc, l.phrase) as rank
  from lowest l left join covered v on v.lang = l.lang and v.part = l.phrase
  where coalesce(v.longer, 0) < a
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n,
  score::bigint as score
from ranked where rank <= 2000
"""
ORACLES: dict[str, str] = {"op10_lines": _OP10_SQL, "op11_audit": _OP11_SQL, "op12_collocations": _OP12_SQL}
