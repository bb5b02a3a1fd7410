import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("venuelens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def reviews_of(spark):
    """A review table from ``(cafe_id, text)`` or ``(cafe_id, text, rating)`` rows."""

    def build(*rows):
        full = [(i, r[0], r[2] if len(r) > 2 else None, r[1]) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "review_id bigint, cafe_id bigint, rating double, review_text string"
        )

    return build


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
