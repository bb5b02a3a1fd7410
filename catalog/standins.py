"""Venues, reviews and preferences derived from the generic test tables.

The same SQL text runs in Spark and, as common table expressions, in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from venuelens import clean_venues
from venuelens.operators.sentiment import SentimentRules
from venuelens.session import spread

VENUES_SQL = """
select p_partkey as cafe_id, p_name as name, p_brand as area, 'Town' as location,
  case when p_size<=20 then '₹' when p_size<=38 then '₹₹' when p_size<=47 then '₹₹₹' else 'n/a' end as budget,
  case p_type when 'ECONOMY' then 'Minimal' when 'LARGE' then 'Heritage' when 'MEDIUM' then 'Rooftop'
    when 'PROMO' then 'Luxury' when 'SMALL' then 'Artsy' else 'Garden' end as atmosphere,
  case p_partkey % 6 when 0 then 'Study|Work' when 1 then 'Date' when 2 then 'Friends|Date'
    when 3 then 'Solo|Study' when 4 then 'Friends, Solo' else 'Brunch' end as purpose_tags,
  case p_size % 3 when 0 then 'Low' when 1 then 'Medium' else 'High' end as noise_level,
  case when p_partkey % 11 = 0 then 'nan' when p_partkey % 2 = 0 then 'True' else 'False' end as pet_friendly,
  case when p_partkey % 13 = 0 then null when p_partkey % 3 = 0 then 'TRUE' else 'false' end as outdoor_seating,
  case when p_partkey % 5 < 3 then 'True' else 'False' end as charging_sockets,
  case when p_partkey % 4 < 3 then 'true' else 'false' end as free_wifi,
  case when p_partkey % 7 = 0 then 'False' else 'True' end as open_now,
  cast(cast((p_partkey*7)  % 61 + 40 as double)/10 as decimal(4,1)) as coffee_score,
  cast(cast((p_partkey*11) % 61 + 40 as double)/10 as decimal(4,1)) as dessert_score,
  cast(cast((p_partkey*13) % 61 + 40 as double)/10 as decimal(4,1)) as study_score,
  cast(cast((p_partkey*17) % 61 + 40 as double)/10 as decimal(4,1)) as date_score,
  cast(cast((p_partkey*19) % 61 + 40 as double)/10 as decimal(4,1)) as instagram_score,
  cast(cast((p_partkey*23) % 61 + 40 as double)/10 as decimal(4,1)) as wifi_score,
  cast((p_partkey*29) % 21 + 30 as double)/10 as overall_rating
from part
"""

REVIEWS_SQL = """
select doc_id as review_id, case when doc_id % 97 = 96 then -1 else doc_id % 50 end as cafe_id,
  case when doc_id % 41 = 40 then null else cast((doc_id*7) % 9 as double)/2 + 1 end as rating,
  text as review_text
from documents
"""

#: The same tables with keys that are text.
TEXT_VENUES_SQL = VENUES_SQL.replace("p_partkey as cafe_id", "concat('V', cast(p_partkey as string)) as cafe_id")
TEXT_REVIEWS_SQL = REVIEWS_SQL.replace("doc_id as review_id", "concat('R', cast(doc_id as string)) as review_id").replace(
    "case when doc_id % 97 = 96 then -1 else doc_id % 50 end as cafe_id",
    "case when doc_id % 97 = 96 then 'none' else concat('V', cast(doc_id % 50 as string)) end as cafe_id",
)

PREFS_SQL = """
select c_custkey as user_id,
  case c_nationkey % 7 when 0 then 'Minimal' when 1 then 'Heritage' when 2 then 'Rooftop' when 3 then 'Luxury'
    when 4 then 'Artsy' when 5 then 'Nature' else '' end as atmosphere,
  case c_custkey % 6 when 0 then 'Study' when 1 then 'Date' when 2 then 'Friends' when 3 then 'Solo'
    when 4 then 'Work' else '' end as purpose,
  case when c_custkey % 17 = 0 then '' else concat('Rs ', cast((c_custkey*37) % 3000 as string)) end as budget_text,
  case when c_custkey % 5 = 0 then null else cast((c_custkey*3) % 11 as double)/10 end as coffee,
  cast((c_custkey*5) % 11 as double)/10 as dessert, cast((c_custkey*7) % 11 as double)/10 as study,
  cast((c_custkey*2) % 11 as double)/10 as date, cast((c_custkey*4) % 11 as double)/10 as instagram,
  cast((c_custkey*6) % 11 as double)/10 as wifi
from customer
"""

#: Substrings that occur in the invented prose of the test corpus.
ASPECTS = {
    "coffee": ["tion"],
    "dessert": ["heit", "keit"],
    "wifi": ["ment"],
    "service": ["ing", "ere"],
    "ambience": ["ado"],
    "price": ["lich", "eux"],
    "noise": ["schz"],
}

LEXICON = [
    ("the", 0.4), ("of", -0.3), ("and", 1.2), ("that", -1.6), ("with", 2.1), ("was", -1.9),
    ("for", 0.7), ("die", -2.4), ("que", 1.1), ("der", 0.5), ("la", 1.3), ("un", -0.8),
]

#: Word sequences and letters of the corpus that stand for idioms and emoji; some overlap, one begins another.
PHRASES = [
    ("of the", -1.1), ("of the and", 2.2), ("the and of", 1.4), ("et  LA", 1.7), ("der und", -2.0), ("the of", 0.9),
    ("les la", -1.3), ("und that", 2.6), ("that", 0.6),
]
SYMBOLS = [("ç", "der"), ("ß", "und that"), ("ßt", "la"), ("ê", "")]

#: Modifier words that do occur in the corpus, so that every rule fires.
RULES = SentimentRules(
    boosters={"le": 0.293, "is": 0.293, "les": -0.293, "und": -0.293},
    negators=("de", "not", "in", "nicht"),
    negation_mark="n't",
    contrast="et",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_venues(spark: SparkSession, sf_dir: str, text_keys: bool = False) -> DataFrame:
    return spark.sql((TEXT_VENUES_SQL if text_keys else VENUES_SQL).replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_venues(raw_venues(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str, text_keys: bool = False) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return spark.sql((TEXT_REVIEWS_SQL if text_keys else REVIEWS_SQL).replace("from documents", "from {docs}"), docs=docs)


def prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return spark.sql(PREFS_SQL.replace("from customer", "from {customers}"), customers=customers)


def lexicon(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}', {v}D)" for t, v in LEXICON)
    return spark.sql(f"select * from values {rows} as l(token, valence)")


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHRASES, "phrase string, valence double")


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, "symbol string, description string")
