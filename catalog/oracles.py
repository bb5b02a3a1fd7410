"""The same results in plain SQL, independent of the DataFrame code."""

from __future__ import annotations

from catalog import standins as S
from venuelens import vocab
from venuelens.plans.dashboard import BOARDS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def exact_round(x: str, digits: int) -> str:
    """Half-even on the exact binary value of the column ``x``."""
    m = f"{10 ** digits}e0"
    p = f"({x}*{m})"
    c = f"({x}*134217729e0)"
    hi = f"({c}-({c}-{x}))"
    err = f"(({hi}*{m}-{p})+({x}-{hi})*{m})"
    fl = f"floor({p})"
    frac = f"({p}-{fl})"
    return (
        f"(case when {frac}<0.5e0 or ({frac}=0.5e0 and {err}<0) or "
        f"({frac}=0.5e0 and {err}=0 and ({fl}%2)=0) then {fl} else {fl}+1 end / {m})"
    )


def scaled_round(x: str, digits: int) -> str:
    return f"(round_even(({x})*{10 ** digits}e0, 0)/{10 ** digits}e0)"


def case_of(col: str, table: dict, default: str = "null") -> str:
    whens = " ".join(
        f"when {lit(k)} then {lit(v) if isinstance(v, str) else v}" for k, v in table.items()
    )
    return f"case {col} {whens} else {default} end"


# Unicode whitespace for a regex engine whose \s is ASCII only
WS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]"
)
PUNCT = r"[!-/:-@\[-`{-~]"
NO_REVIEWS = lit(vocab.NO_REVIEWS_SUMMARY)

# -- shared common table expressions -------------------------------------------

FLAGS = ", ".join(
    f"case lower({c}) when 'true' then true when 'false' then false end as {c}"
    for c in vocab.FLAG_COLS
)
COMPOSITE_TERMS = " + ".join(f"cast({c} as double)*{w}e0" for c, w in vocab.COMPOSITE_WEIGHTS.items())

RAW = f"raw_venues as ({S.VENUES_SQL})"
VENUES = f"""{RAW},
venues as (
  select cafe_id, name, area, location, budget, {case_of('budget', vocab.BUDGET_SYMBOLS)} as budget_label,
    atmosphere, replace(purpose_tags, '|', ',') as purpose_tags, noise_level, {FLAGS},
    {', '.join(vocab.SCORE_COLS)}, overall_rating
  from raw_venues)"""
REVIEWS = f"reviews as ({S.REVIEWS_SQL})"
PREFS = f"""prefs as ({S.PREFS_SQL}),
amounts as (
  select *, regexp_replace(coalesce(budget_text, ''), '[^0-9]', '', 'g') as digits from prefs),
parsed as (
  select *, case when digits = '' then 700
    else try_cast(digits as bigint) end as amount
  from amounts),
labelled as (
  select *, case when amount <= 700 then 'Under 700' when amount <= 2000 then '700 to 2000'
    else 'Above 2000' end as label
  from parsed)"""
SCORED = f"""{VENUES},
summed as (select *, {COMPOSITE_TERMS} as x from venues),
scored as (select * exclude (x), {exact_round('x', 2)} as ai_recommendation_score from summed)"""
STATS = f"""stats as (
  select cafe_id, count(*) as num_reviews, {scaled_round('avg(rating)', 2)} as avg_review_rating,
    max(case when regexp_replace(coalesce(review_text, ''), '{WS}', '', 'g') <> '' then 1 else 0 end) = 1 as has_text
  from reviews group by cafe_id)"""
SENTENCES = f"""cut as (
  select cafe_id, review_id,
    list_filter(string_split(
      regexp_replace(regexp_replace(review_text, '^{WS}+|{WS}+$', '', 'g'), '([.!?]){WS}+', '\\1' || chr(1), 'g'),
      chr(1)), lambda s: s <> '') as parts
  from reviews),
sentences as (
  select cafe_id, review_id, unnest(range(0, len(parts))) as sent_pos, unnest(parts) as sentence
  from cut)"""
COUNTS = f"""listed as (
  select cafe_id, review_id, regexp_extract_all(lower(review_text), '[a-zA-Z'']+') as ws from reviews),
words as (
  select cafe_id, review_id, unnest(range(0, len(ws))) as word_pos, unnest(ws) as word from listed),
counts as (
  select cafe_id, word, count(*) as n, min((review_id, word_pos)) as first_at
  from words where word not in {in_list(vocab.STOPWORDS)} group by cafe_id, word)"""
KEYWORDS = """ranked_words as (
  select cafe_id, word, n, row_number() over (partition by cafe_id order by n desc, first_at) as rank
  from counts where length(word) > 3),
keywords as (select cafe_id, rank, word, n from ranked_words where rank <= 6)"""
SUMMARY = f"""long_enough as (
  select *, lower(sentence) as key from sentences
  where len(regexp_split_to_array(sentence, '{WS}+')) >= 4),
firsts as (
  select *, row_number() over (partition by cafe_id, key order by review_id, sent_pos) as copy
  from long_enough),
distinct_sentences as (
  select cafe_id, review_id, sent_pos, sentence, regexp_extract_all(key, '[a-zA-Z'']+') as ws
  from firsts where copy = 1),
sentence_words as (
  select cafe_id, review_id, sent_pos, unnest(ws) as word from distinct_sentences),
weights as (
  select w.cafe_id, w.review_id, w.sent_pos, sum(c.n) as weight
  from sentence_words w join counts c on c.cafe_id = w.cafe_id and c.word = w.word
  group by all),
salient as (
  select d.*, len(ws) as n_words, cast(coalesce(weight, 0) as bigint) as weight
  from distinct_sentences d left join weights using (cafe_id, review_id, sent_pos)),
ranked_sentences as (
  select *, row_number() over (
    partition by cafe_id order by weight / (n_words + 1) desc, review_id, sent_pos) as rank
  from salient),
largest as (select cafe_id, max(n) as max_n from counts group by cafe_id),
summary_sentences as (
  select r.cafe_id, rank, review_id, sent_pos, n_words, weight,
    weight / coalesce(max_n, 1) / (n_words + 1) as score, sentence
  from ranked_sentences r left join largest using (cafe_id) where rank <= 3),
summary_texts as (
  select cafe_id, string_agg(sentence, ' ' order by rank) as txt from summary_sentences group by cafe_id),
summaries as (
  select cafe_id, coalesce(txt, case when has_text then '' else {NO_REVIEWS} end) as ai_summary
  from stats left join summary_texts using (cafe_id))"""
LIGHT = f"""analysis as (
  select v.cafe_id, ai_recommendation_score, coalesce(num_reviews, 0) as num_reviews,
    avg_review_rating, coalesce(ai_summary, {NO_REVIEWS}) as ai_summary
  from scored v left join stats using (cafe_id) left join summaries using (cafe_id))"""
ANALYSIS = f"{SCORED}, {REVIEWS}, {STATS}, {SENTENCES}, {COUNTS}, {SUMMARY}, {LIGHT}"

LEXICON = "lexicon(token, valence) as (values " + ", ".join(
    f"({lit(t)}, {v}e0)" for t, v in S.LEXICON
) + ")"


def compound(total: str, name: str = "compound") -> tuple[str, str]:
    """The squeezed value and its rounding, for two nested selects."""
    squeezed = f"greatest(-1e0, least(1e0, {total}/sqrt({total}*{total}+15e0)))"
    return squeezed, f"{exact_round('squeezed', 4)} as {name}"


def sentence_tokens(source: str) -> str:
    """Tokens of the sentences in ``source``: whitespace runs, outer punctuation removed."""
    bare = f"regexp_replace(t, '^{PUNCT}+|{PUNCT}+$', '', 'g')"
    return f"""split_tokens as (
  select *, list_transform(regexp_split_to_array(sentence, '{WS}+'),
    lambda t: case when length({bare}) <= 2 then t else {bare} end) as toks
  from {source})"""


def merged_tokens(source: str) -> str:
    """The tokens with the words of each phrase put together; every token stands between two blanks of its own."""
    listed = sorted({" ".join(p.lower().split()) for p, _ in S.PHRASES if len(p.split()) > 1}, key=lambda p: (-len(p), p))
    pattern = "|".join(p.replace(" ", "  ") for p in listed)
    return f"""{sentence_tokens(source).replace('split_tokens as', 'single_tokens as', 1)},
marked_phrases as (
  select *, regexp_replace(' ' || array_to_string(toks, '  ') || ' ', ' ({pattern}) ', ' ' || chr(2) || '\\1' || chr(3) || ' ', 'gi') as line
  from single_tokens),
split_tokens as (
  select * exclude (toks, line), list_filter(flatten(list_transform(string_split(line, chr(2)), lambda p:
    case when contains(p, chr(3)) then list_concat([replace(split_part(p, chr(3), 1), '  ', ' ')], string_split(split_part(p, chr(3), 2), ' '))
    else string_split(p, ' ') end)), lambda t: t <> '') as toks
  from marked_phrases)"""


#: Sentences with the symbols read as their descriptions, the longest symbol first.
DESCRIBED = (
    "described as (select * replace (case when regexp_matches(sentence, '[" + "".join(x[0] for x, _ in S.SYMBOLS)
    + f"]') then regexp_replace(regexp_replace(regexp_replace("
    + "replace(" * len(S.SYMBOLS) + "sentence"
    + "".join(f", {lit(x)}, {lit(' ' + d + ' ')})" for x, d in sorted(S.SYMBOLS, key=lambda r: -len(r[0])))
    + f", '{WS}+', ' ', 'g'), '^ ', ''), ' $', '') else sentence end as sentence) from sentences)"
)
PHRASE_LEXICON = "lexicon(token, valence) as (values " + ", ".join(
    f"({lit(t)}, {v}e0)" for t, v in {**dict(S.LEXICON), **{" ".join(p.lower().split()): v for p, v in S.PHRASES}}.items()
) + ")"


def core(source: str) -> str:
    squeezed, rounded = compound("total")
    return f"""{sentence_tokens(source)},
token_rows as (
  select cafe_id, review_id, sent_pos, unnest(list_transform(toks, lambda t: lower(t))) as token from split_tokens),
totals as (
  select cafe_id, review_id, sent_pos, coalesce(sum(valence), 0e0) as total
  from token_rows left join lexicon using (token) group by all),
squeezed_totals as (select *, {squeezed} as squeezed from totals),
compounds as (select cafe_id, review_id, sent_pos, {rounded} from squeezed_totals)"""


def modifiers(source: str) -> str:
    r = S.RULES
    boost = case_of("c.token", r.boosters, "0e0").replace("0.293", "0.293e0")
    steps = []
    value = "v0"
    for i, damp in enumerate(r.damping, start=1):
        # value -> lifted by a degree word -> turned by a negation, if the cue word is plain
        scalar = f"(case when {value} < 0 then -b{i} else b{i} end)"
        loud = (
            f"(case when u{i} then (case when {value} > 0 then {scalar}+{r.capitals}e0 "
            f"else {scalar}-{r.capitals}e0 end) else {scalar} end)"
        )
        lifted = f"({value} + case when b{i} <> 0 then {loud}*{damp}e0 else 0e0 end)"
        so, doubt = ((" or ".join(f"coalesce(t{k} in ({w}), false)" for k in range(1, i)) or "false") for w in ("'so','this'", "'doubt'"))
        turned = (
            f"{lifted} * case when t{i} = 'never' and ({so}) then {r.never_so}e0 when t{i} = 'without' and ({doubt}) then 1e0 "
            f"when g{i} then ({r.negation}e0) else 1e0 end"
        )
        steps.append(
            f"step{i} as (select *, case when p{i} then {turned} else {value} end as v{i} "
            f"from {'looked' if i == 1 else f'step{i - 1}'})"
        )
        value = f"v{i}"
    lags = ", ".join(
        f"lag({col}, {i}) over look as {name}{i}"
        for i in (1, 2, 3)
        for col, name in (("boost", "b"), ("negates", "g"), ("shouted", "u"), ("plain", "p"), ("token", "t"))
    )
    squeezed, rounded = compound("signed")
    return f"""{sentence_tokens(source)},
marked as (
  select *,
    least(length(sentence) - length(replace(sentence, '!', '')), {r.exclamations}) * {r.exclamation}e0
    + case when length(sentence) - length(replace(sentence, '?', '')) <= 1 then 0e0
        when length(sentence) - length(replace(sentence, '?', '')) <= {r.questions}
          then (length(sentence) - length(replace(sentence, '?', ''))) * {r.question}e0
        else {r.many_questions}e0 end as emphasis,
    len(list_filter(toks, lambda t: t = upper(t) and t <> lower(t))) as n_upper,
    list_position(list_transform(toks, lambda t: lower(t)), {lit(r.contrast)}) as contrast_at
  from split_tokens),
token_rows as (
  select cafe_id, review_id, sent_pos, emphasis, contrast_at, n_upper > 0 and n_upper < len(toks) as mixed,
    unnest(range(1, len(toks) + 1)) as tok_at, unnest(toks) as raw
  from marked),
cues as (
  select t.*, lower(raw) as token, mixed and raw = upper(raw) and raw <> lower(raw) as shouted
  from token_rows t),
cued as (
  select c.*, valence, valence is null as plain, {boost} as boost,
    c.token in {in_list(r.negators)} or contains(c.token, {lit(r.negation_mark)}) as negates
  from cues c left join lexicon l on l.token = c.token),
seen as (
  select *, lead(valence) over look as next_valence, {lags}
  from cued window look as (partition by review_id, sent_pos order by tok_at)),
own as (
  select *, case when t1 = 'no' or t2 = 'no' or (t3 = 'no' and t1 in ('or', 'nor')) then valence * ({r.negation}e0)
    when token = 'no' and valence is not null and next_valence is not null then 0e0 else valence end as w
  from seen),
looked as (
  select *, case when shouted then (case when w > 0 then w + {r.capitals}e0 else w - {r.capitals}e0 end) else w end as v0
  from own),
{', '.join(steps)},
counted as (
  select *, case when boost <> 0 then 0e0 else coalesce(v3, 0e0) * case
      when t1 = 'least' and p1 and coalesce(t2 not in ('at', 'very'), true) then ({r.negation}e0) else 1e0 end end as c
  from step3),
totals as (
  select cafe_id, review_id, sent_pos, emphasis,
    sum(case when contrast_at > 0 and tok_at < contrast_at then c * {r.before_contrast}e0
      when contrast_at > 0 and tok_at > contrast_at then c * {r.after_contrast}e0 else c end) as total
  from counted group by all),
signed_totals as (
  select *, case when total > 0 then total + emphasis when total < 0 then total - emphasis
    else total end as signed
  from totals),
squeezed_totals as (select *, {squeezed} as squeezed from signed_totals),
compounds as (select cafe_id, review_id, sent_pos, {rounded} from squeezed_totals)"""


MENTIONS = "mentions as (" + " union all ".join(
    f"select cafe_id, review_id, sent_pos, {lit(a)} as aspect from sentences where "
    + " or ".join(f"contains(lower(sentence), {lit(k)})" for k in kws)
    for a, kws in S.ASPECTS.items()
) + ")"
ASPECTS = f"""{LEXICON}, {modifiers('sentences')}, {MENTIONS},
per_review as (
  select cafe_id, review_id, aspect, count(*) as n_sentences, avg(compound) as compound
  from mentions join compounds using (cafe_id, review_id, sent_pos) group by all),
means as (
  select cafe_id, aspect, count(*) as n_reviews, avg(compound) as mean from per_review group by all),
tens as (select *, (round(mean, 12) + 1e0) / 2e0 * 10e0 as ten from means),
per_venue as (
  select cafe_id, aspect, n_reviews, mean as compound, {exact_round('ten', 1)} as score from tens)"""
FULL = f"""{SCORED}, {REVIEWS}, {STATS}, {SENTENCES}, {COUNTS}, {KEYWORDS}, {SUMMARY}, {ASPECTS},
aspect_texts as (
  select cafe_id, string_agg(aspect || '=' || cast(score as varchar), ',' order by aspect) as aspects
  from per_venue group by cafe_id),
keyword_texts as (
  select cafe_id, string_agg(word, ' ' order by rank) as words from keywords group by cafe_id),
full_analysis as (
  select v.cafe_id, name, coalesce(num_reviews, 0) as num_reviews, avg_review_rating, overall_rating,
    {', '.join(f'cast({c} as double) as {c}' for c in vocab.SCORE_COLS)}, noise_level, budget,
    ai_recommendation_score, coalesce(aspects, '') as aspect_sentiment_10,
    coalesce(ai_summary, {NO_REVIEWS}) as ai_summary, coalesce(words, '') as keywords
  from scored v left join stats using (cafe_id) left join aspect_texts using (cafe_id)
    left join summaries using (cafe_id) left join keyword_texts using (cafe_id))"""

# -- recommendation --------------------------------------------------------------

SHORT = list(vocab.PRIORITY_DEFAULTS)
ORDINAL = "coalesce(" + case_of("{0}", vocab.BUDGET_MAP) + ", 2)/3e0"


def tag_hit(purpose: str) -> str:
    return f"list_contains(tags, {lit(purpose)})"


ENCODED = f"""tagged as (
  select *, list_transform(string_split(replace(purpose_tags, '|', ','), ','), lambda t: trim(t)) as tags
  from venues),
v as (
  select cafe_id, budget_label, atmosphere in {in_list(vocab.ATMOSPHERES)} as known, atmosphere, tags,
    {' + '.join(f'cast({tag_hit(p)} as int)' for p in vocab.PURPOSES)} as n_tags,
    {', '.join(f'cast({c} as double)/10e0 as s{i}' for i, c in enumerate(vocab.SCORE_COLS))},
    {ORDINAL.format('budget_label')} as b
  from tagged),
vn as (
  select *, sqrt(cast(cast(known as int) + n_tags as double)
    + {' + '.join(f's{i}*s{i}' for i in range(6))} + b*b) as norm
  from v),
u as (
  select user_id, atmosphere as ua, purpose as up, label,
    atmosphere in {in_list(vocab.ATMOSPHERES)} as knowa, purpose in {in_list(vocab.PURPOSES)} as knowp,
    {', '.join(f'coalesce({c}, {d}e0) as p{i}' for i, (c, d) in enumerate(vocab.PRIORITY_DEFAULTS.items()))},
    {ORDINAL.format('label')} as t
  from labelled),
un as (
  select *, sqrt(cast(cast(knowa as int) + cast(knowp as int) as double)
    + {' + '.join(f'p{i}*p{i}' for i in range(6))} + t*t) as unorm
  from u)"""
SIMILARITY = f"""(cast(cast(knowa and ua = atmosphere as int) + cast(knowp and list_contains(tags, up) as int) as double)
    + {' + '.join(f's{i}*p{i}' for i in range(6))} + b*t) / (norm*unorm)"""


def matches(where: str = "true", k: int = 5, knn: bool = False) -> str:
    value = "1e0 - (1e0 - sim)" if knn else "sim"
    distance = ", 1e0 - sim as distance" if knn else ""
    order = "1e0 - sim, cafe_id" if knn else "sim desc, cafe_id"
    return f"""pairs as (select user_id, cafe_id, {SIMILARITY} as sim from un cross join vn where {where}),
best as (
  select *, row_number() over (partition by user_id order by {order}) as place from pairs
  qualify place <= {k}),
shown as (
  select user_id, cafe_id, {value} as similarity{distance}, {scaled_round(f'({value})*100e0', 1)} as match_score
  from best),
matches as (
  select user_id, row_number() over (
    partition by user_id order by match_score desc, similarity desc, cafe_id) as rank,
    cafe_id, similarity{', distance' if knn else ''}, match_score
  from shown)"""


RECOMMEND = f"{VENUES}, {PREFS}, {ENCODED}"
# -- vectors -----------------------------------------------------------------------

MEANS = """parts as (
  select label, unnest(range(0, len(embedding))) as place, cast(unnest(embedding) as double) as part
  from embeddings),
averages as (select label, place, avg(part) as part from parts group by all),
directions as (select label, list(part order by place) as direction from averages group by label)"""


def board(name: str) -> str:
    by, k, symbol = BOARDS[name]
    where = "" if symbol is None else f"where budget = {lit(symbol)}"
    scores = ", ".join(f"cast({c} as double) as {c}" for c in vocab.SCORE_COLS)
    return f"""with {SCORED} select cafe_id, name, area, {scores}, ai_recommendation_score from scored
{where} order by {by} desc, cafe_id limit {k}"""


FIRST_BY_NAME = "firsts_by_name as (select min(cafe_id) as cafe_id from venues group by name)"
CARD_PLACE = "area || ', ' || location"
JSON_FIELDS = [
    "cafe_id", "name", "num_reviews", "avg_review_rating", "overall_rating", *vocab.SCORE_COLS,
    "noise_level", "budget", "ai_recommendation_score", "aspect_sentiment_10", "ai_summary", "keywords",
]
JSON = f"""{FULL},
aspect_maps as (
  select cafe_id, map_from_entries(list((aspect, score) order by aspect)) as m from per_venue group by cafe_id),
keyword_arrays as (select cafe_id, list(word order by rank) as l from keywords group by cafe_id),
records as (
  select f.* exclude (aspect_sentiment_10, keywords), coalesce(m, map {{}}) as aspect_sentiment_10,
    coalesce(l, []) as keywords
  from full_analysis f left join aspect_maps using (cafe_id) left join keyword_arrays using (cafe_id))"""

ORACLES: dict[str, str] = {
    "clean_venues": f"""with {VENUES}, tagged as (
  select *, list_transform(string_split(purpose_tags, ','), lambda t: trim(t)) as l from venues)
select cafe_id, name, area, location, budget, budget_label, atmosphere, purpose_tags,
  array_to_string(l, '|') as tags, len(l) as n_tags, noise_level, {', '.join(vocab.FLAG_COLS)}, overall_rating
from tagged""",
    "venues_csv": f"""with {VENUES} select cafe_id, name, budget_label, purpose_tags,
  {', '.join(vocab.FLAG_COLS)}, cast(coffee_score as double) as coffee_score, overall_rating from venues""",
    "venues_files": f"""with {VENUES} select cafe_id, name, budget_label, purpose_tags,
  {', '.join(vocab.FLAG_COLS)}, cast(coffee_score as double) as coffee_score, overall_rating from venues""",
    "reviews_csv": f"with {REVIEWS} select review_id, cafe_id, rating, review_text from reviews",
    "reviews_files": f"with {REVIEWS} select review_id, cafe_id, rating, review_text from reviews",
    "budget_parse": f"with {PREFS} select user_id, budget_text, amount, label from labelled",
    "facet_filter": f"""with {VENUES} select cafe_id, name, noise_level from venues
where outdoor_seating and noise_level = 'Low' and free_wifi""",
    "facet_filter_any": f"""with {VENUES} select cafe_id, name, atmosphere from venues
where open_now and pet_friendly and charging_sockets and atmosphere = 'Rooftop'""",
    "budget_equality": f"with {VENUES} select cafe_id, budget_label from venues where budget_label = 'Under 700'",
    "score_profile": f"with {VENUES} "
    + " union all ".join(
        f"select cafe_id, {lit(label)} as label, cast({c} as double) as score from venues"
        for c, label in vocab.SHORT_SCORE_LABELS.items()
    ),
    "venue_names": f"with {VENUES} select name from venues",
    "venues_by_name": f"""with {VENUES}, {FIRST_BY_NAME}
select cafe_id, name, area from venues join firsts_by_name using (cafe_id)""",
    "composite_all": f"with {SCORED} select cafe_id, ai_recommendation_score from scored",
    "composite_top8": f"""with {SCORED}, {REVIEWS}, {STATS}
select cafe_id, name, ai_recommendation_score, coalesce(num_reviews, 0) as num_reviews, avg_review_rating
from scored left join stats using (cafe_id) order by ai_recommendation_score desc, cafe_id limit 8""",
    **{f"leaderboard_{name}": board(name) for name in BOARDS},
    "dashboard_kpis": f"""with {SCORED}, {REVIEWS}, {STATS}, figures as (
  select count(*) as total_venues, cast(coalesce(sum(num_reviews), 0) as bigint) as total_reviews,
    cast(sum(cast(ai_recommendation_score as decimal(20,8))) as double)/count(*) as avg_ai_score,
    cast(sum(cast(overall_rating as decimal(20,8))) as double)/count(*) as avg_overall_rating
  from scored left join stats using (cafe_id))
select *, {exact_round('avg_ai_score', 1)} as avg_ai_score_shown,
  {exact_round('avg_overall_rating', 1)} as avg_overall_rating_shown from figures""",
    "review_stats": f"""with {VENUES}, {REVIEWS}, {STATS}
select cafe_id, coalesce(num_reviews, 0) as num_reviews, avg_review_rating, coalesce(has_text, false) as has_text
from venues left join stats using (cafe_id)""",
    "venue_card": f"""with {ANALYSIS}
select v.cafe_id, name,
  {CARD_PLACE} || ' · ' || budget || ' · ' || atmosphere || ' atmosphere · Noise: ' || noise_level as caption,
  concat_ws(' · ', replace(purpose_tags, ',', ', '), budget_label) as tags,
  cast(a.ai_recommendation_score as varchar) || '/10' as ai_score,
  {', '.join(f"cast(cast({c} as double) as varchar) || '/10' as show_{c.removesuffix('_score')}" for c in vocab.SCORE_COLS)},
  ai_summary as summary, num_reviews as reviews,
  coalesce(cast(avg_review_rating as varchar), 'N/A') as rating
from venues v join analysis a using (cafe_id)""",
    "venue_reviews": f"""with {REVIEWS}
select cafe_id, review_id, cast(trunc(rating) as int) as stars, review_text from reviews""",
    "sentences": f"with {REVIEWS}, {SENTENCES} select cafe_id, review_id, sent_pos, sentence from sentences",
    "tokens": f"""with {REVIEWS}, {SENTENCES}, found as (
  select *, regexp_extract_all(lower(sentence), '[a-zA-Z'']+') as ws from sentences)
select review_id, sent_pos, len(regexp_split_to_array(sentence, '{WS}+')) as n_tokens,
  len(ws) as n_words, array_to_string(ws, ' ') as words from found""",
    "term_counts": f"with {REVIEWS}, {COUNTS} select cafe_id, word, n from counts",
    "keywords_top6": f"with {REVIEWS}, {COUNTS}, {KEYWORDS} select cafe_id, rank, word, n from keywords",
    "keyword_lists": f"""with {REVIEWS}, {COUNTS}, {KEYWORDS}
select cafe_id, string_agg(word, ' ' order by rank) as keywords from keywords group by cafe_id""",
    "summary_sentences": f"""with {REVIEWS}, {STATS}, {SENTENCES}, {COUNTS}, {SUMMARY}
select * from summary_sentences""",
    "summary_text": f"""with {REVIEWS}, {STATS}, {SENTENCES}, {COUNTS}, {SUMMARY}
select cafe_id, ai_summary from summaries""",
    "sentence_sentiment": f"""with {REVIEWS}, {SENTENCES}, {LEXICON}, {core('sentences')}
select review_id, sent_pos, cafe_id, compound from compounds""",
    "sentence_sentiment_modifiers": f"""with {REVIEWS}, {SENTENCES}, {LEXICON}, {modifiers('sentences')}
select review_id, sent_pos, cafe_id, compound from compounds""",
    "sentence_sentiment_idioms": f"""with {REVIEWS}, {SENTENCES}, {DESCRIBED}, {PHRASE_LEXICON},
{modifiers('described').replace(sentence_tokens('described'), merged_tokens('described'))}
select review_id, sent_pos, cafe_id, compound from compounds""",
    "text_sentiment": f"""with {REVIEWS}, whole as (
  select cafe_id, review_id, 0 as sent_pos, regexp_replace(review_text, '^{WS}+|{WS}+$', '', 'g') as sentence
  from reviews), {LEXICON}, {modifiers('whole')}
select review_id, cafe_id, compound from compounds""",
    "aspect_mentions": f"""with {REVIEWS}, {SENTENCES}, {MENTIONS}
select cafe_id, review_id, sent_pos, aspect from mentions""",
    "aspect_mentions_table": f"""with {REVIEWS}, {SENTENCES}, {MENTIONS},
keyword_table as (
  select distinct substr(word, 1, 1) as aspect, word as keyword
  from (select unnest(regexp_extract_all(lower(review_text), '[a-zA-Z'']+')) as word from reviews)
  where length(word) between 6 and 12),
pieces as (
  select cafe_id, review_id, sent_pos, substr(s, from_char + 1, 211) as piece
  from (select *, unnest(range(0, length(s), 200)) as from_char from (select *, lower(sentence) as s from sentences))),
runs as (
  select distinct cafe_id, review_id, sent_pos, substr(piece, i, n) as run
  from (select *, unnest(range(1, length(piece) - n + 2)) as i from pieces, range(6, 13) r(n) where length(piece) >= n))
select cafe_id, review_id, sent_pos, aspect from mentions
union
select cafe_id, review_id, sent_pos, aspect from runs join keyword_table on run = keyword""",
    "aspect_by_review": f"""with {REVIEWS}, {SENTENCES}, {ASPECTS}
select cafe_id, review_id, aspect, n_sentences, {scaled_round('compound', 10)} as compound from per_review""",
    "aspect_by_venue": f"""with {REVIEWS}, {SENTENCES}, {ASPECTS}
select cafe_id, aspect, n_reviews, {scaled_round('compound', 10)} as compound, score from per_venue""",
    "aspect_map": f"""with {REVIEWS}, {SENTENCES}, {ASPECTS}
select cafe_id, aspect, score from per_venue""",
    "signed_model_score": """select l.doc_id, quality, length(text) as n_read,
  case when quality = 1 then cast(l.doc_id % 50 + 50 as double)/100
    else -(cast(l.doc_id % 50 + 50 as double)/100) end as compound
from labels l join documents d on d.doc_id = l.doc_id""",
    "conversation_scores": """with t as (
  select conv_id as review_id, turn as sent_pos, role,
    unnest([{'at': i, 's': substring(text, i, 512)} for i in range(1, greatest(length(text), 1) + 1, 512)]) as w
  from conversations), best as (
  select *, row_number() over (partition by review_id, sent_pos order by length(w.s) desc, w.at) as place from t)
select review_id, sent_pos, role,
  case when contains(lower(w.s), 'tion') then length(w.s)/512e0 else -(length(w.s)/512e0) end as compound
from best where place = 1""",
    "analysis_full": f"with {FULL} select * from full_analysis",
    "analysis_json": f"""with {JSON} select cafe_id,
  cast(json_object({', '.join(f"{lit(c)}, {c}" for c in JSON_FIELDS)}) as varchar) as json from records""",
    "venue_report_header": f"""with {ANALYSIS}, {FIRST_BY_NAME}
select v.cafe_id, name, {CARD_PLACE} || ' · ' || budget || ' · ' || atmosphere || ' atmosphere' as caption,
  overall_rating, a.ai_recommendation_score, noise_level, num_reviews, ai_summary
from venues v join firsts_by_name using (cafe_id) join analysis a using (cafe_id)""",
    "venue_report_scores": f"with {VENUES}, {FIRST_BY_NAME}, chosen as ("
    "select * from venues join firsts_by_name using (cafe_id)) "
    + " union all ".join(
        f"select cafe_id, {lit(label)} as label, cast({c} as double) as score from chosen"
        for c, label in vocab.DETAIL_SCORE_LABELS.items()
    ),
    "venue_report_aspects": f"""with {VENUES}, {FIRST_BY_NAME}, {REVIEWS}, {SENTENCES}, {ASPECTS}
select cafe_id, aspect, score from per_venue join firsts_by_name using (cafe_id)""",
    "venue_report_reviews": f"""with {VENUES}, {FIRST_BY_NAME}, {REVIEWS}
select cafe_id, review_id, cast(trunc(rating) as int) as stars, review_text
from reviews join firsts_by_name using (cafe_id)""",
    "venue_features": f"""with {RECOMMEND}, vectors as (
  select cafe_id, [
    {', '.join(f"cast(coalesce(atmosphere = {lit(a)}, false) as double)" for a in vocab.ATMOSPHERES)},
    {', '.join(f"cast({tag_hit(p)} as double)" for p in vocab.PURPOSES)},
    {', '.join(f's{i}' for i in range(6))}, b] as f from v)
select cafe_id, unnest(range(0, 18)) as place, unnest(f) as value from vectors""",
    "pref_features": f"""with {RECOMMEND}, vectors as (
  select user_id, [
    {', '.join(f"cast(ua = {lit(a)} as double)" for a in vocab.ATMOSPHERES)},
    {', '.join(f"cast(up = {lit(p)} as double)" for p in vocab.PURPOSES)},
    {', '.join(f'p{i}' for i in range(6))}, t] as f from u)
select user_id, unnest(range(0, 18)) as place, unnest(f) as value from vectors""",
    "pref_map": f"""with {PREFS} select user_id,
  cast(coffee is not null as int) + cast(dessert is not null as int) as n_set,
  coalesce(coffee, 0.8e0) as coffee, 0.5e0 as wifi from prefs""",
    "recommend_cosine": f"with {RECOMMEND}, {matches()} select * from matches",
    "recommend_knn": f"with {RECOMMEND}, {matches(knn=True)} select * from matches",
    "recommend_budget": f"with {RECOMMEND}, {matches('label = budget_label')} select * from matches",
    "recommend_levels": f"""with {RECOMMEND}, {matches("budget_label = 'Under 700'", k=3)}
select * from matches""",
    "recommend_enriched": f"""with {ANALYSIS}, {PREFS}, {ENCODED}, {matches('label = budget_label')}
select user_id, rank, v.cafe_id, name, v.atmosphere, purpose_tags, match_score, a.ai_recommendation_score,
  num_reviews, avg_review_rating, ai_summary
from matches m join venues v on v.cafe_id = m.cafe_id join analysis a on a.cafe_id = m.cafe_id""",
    "submit_form": f"""with {VENUES}, {REVIEWS}, {STATS}, {PREFS}, {ENCODED}, pool as (
  select cafe_id as pool_id from venues where outdoor_seating and free_wifi),
{matches('label = budget_label and cafe_id in (select pool_id from pool)')}
select user_id, rank, m.cafe_id, match_score, coalesce(num_reviews, 0) as num_reviews
from matches m left join stats s on s.cafe_id = m.cafe_id""",
    "match_counts": f"""with {VENUES}, {PREFS}, {ENCODED}, pool as (
  select cafe_id as pool_id from venues
  where outdoor_seating and noise_level = 'Low' and atmosphere = 'Luxury'),
{matches('label = budget_label and cafe_id in (select pool_id from pool)')}
select user_id, count(*) as n_matches from matches group by user_id""",
    "match_counts_all": f"""with {VENUES}, {PREFS}, {ENCODED}, pool as (
  select cafe_id as pool_id from venues
  where outdoor_seating and noise_level = 'Low' and atmosphere = 'Luxury' and budget_label <> 'Above 2000'),
{matches('label = budget_label and cafe_id in (select pool_id from pool)')}
select p.user_id, count(m.user_id) as n_matches from prefs p left join matches m on m.user_id = p.user_id group by p.user_id""",
    "vector_knn": f"""with {MEANS}, pairs as (
  select d.label as query_id, vec_id,
    list_cosine_similarity(cast(embedding as double[]), direction) as sim
  from directions d cross join embeddings),
best as (
  select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from pairs)
select query_id, rank, vec_id, {scaled_round('sim', 9)} as similarity from best where rank <= 5""",
    "vector_cosine": f"""with {MEANS}
select vec_id, e.label, {scaled_round('list_cosine_similarity(cast(embedding as double[]), direction)', 9)} as similarity
from embeddings e join directions d on d.label = e.label""",
}


def with_text_keys(sql: str) -> str:
    return sql.replace(S.VENUES_SQL, S.TEXT_VENUES_SQL).replace(S.REVIEWS_SQL, S.TEXT_REVIEWS_SQL)


_OWN_LABELS = """own_venues as (
  select * exclude (budget_label), case when cafe_id % 9 = 0 then 'Terrace deal' else budget_label end as budget_label
  from venues),
own_prefs as (
  select * exclude (label), case user_id % 5 when 1 then '' when 2 then 'Any' when 3 then 'Terrace deal'
    when 4 then 'Under 700' end as label
  from labelled)"""
_FITS = """label = budget_label
  and (user_id % 2 <> 0 or cafe_id in (select cafe_id from venues where outdoor_seating))
  and (user_id % 3 <> 1 or cafe_id in (select cafe_id from venues where noise_level = 'Low'))
  and (user_id % 5 >= 2 or cafe_id in (select cafe_id from venues where free_wifi))"""
ORACLES |= {
    "text_keys": with_text_keys(f"""with {VENUES}, {REVIEWS}, {STATS}, {SENTENCES}, {COUNTS}, {SUMMARY}
select v.cafe_id, coalesce(num_reviews, 0) as num_reviews, avg_review_rating, ai_summary
from venues v left join stats using (cafe_id) left join summaries using (cafe_id)"""),
    "text_keys_recommend": with_text_keys(f"""with {RECOMMEND}, {matches()}
select * replace (concat('U', user_id) as user_id) from matches"""),
    "recommend_budget_any": f"""with {VENUES}, {PREFS}, {_OWN_LABELS},
{ENCODED.replace('from venues', 'from own_venues').replace('from labelled', 'from own_prefs')},
{matches("coalesce(label, '') in ('', 'Any') or label = budget_label")} select * from matches""",
    "submit_form_facets": f"""with {RECOMMEND}, {matches(_FITS)}
select user_id, rank, cafe_id, match_score from matches""",
    "venue_features_list_tags": ORACLES["venue_features"],
    "enrich_aspects": f"with {FULL} select cafe_id, name, aspect_sentiment_10, num_reviews from full_analysis",
}
