"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Every query runs
once to warm up and once for the record, from building the plan to the last row.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from catalog.runs import QUERIES
from venuelens.session import local_session

HEADLINE = [
    "analysis_full",
    "recommend_cosine",
    "recommend_budget",
    "recommend_enriched",
    "keywords_top6",
    "summary_sentences",
    "sentence_sentiment_modifiers",
    "aspect_by_venue",
    "dashboard_kpis",
    "composite_top8",
    "venue_features",
    "vector_knn",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "venuelens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.ui.showConsoleProgress", "false")
    seconds = {}
    for name in wanted:
        timed(spark, name, sf_dir)
        seconds[name] = round(timed(spark, name, sf_dir), 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
