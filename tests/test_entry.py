import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import normal

SF = "/root/testdata/sf0.001"
QUICK = [
    "composite_all", "dashboard_kpis", "keywords_top6", "summary_text", "aspect_by_venue",
    "recommend_budget", "vector_knn", "reviews_csv",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 8 and "ai_recommendation_score" in df.columns


@pytest.mark.parametrize("name", QUICK)
def test_equals_the_oracle(spark, name):
    con = duckdb.connect()
    for table in "part customer documents embeddings labels conversations".split():
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cursor.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert normal(df.collect(), df.columns) == normal(cursor.fetchall(), cols)
