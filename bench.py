"""Headline queries on one data folder; prints one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the local cores, BENCH_RUNS the runs per query.
A query's time is the best of its runs after one run of each query to load code, and covers
reading the files, planning and producing every row.
"""

from __future__ import annotations

import json
import os
import time

from marquee import catalog
from marquee.session import local_session

HEADLINE = [
    "time_slots",
    "schedule_performance",
    "city_revenue",
    "cannibalization",
    "sales_summary",
    "trend_daily",
    "occupancy_hourly",
    "movie_rankings",
    "cinema_stats",
    "revenue_by_cinema",
    "revenue_by_studio",
    "films_performance",
    "payment_mix",
    "best_ad_slot",
    "early_blockbuster",
    "forecast",
    "last_hour_by_city",
    "scope_metrics",
    "candidate_actions",
    "alerts",
    "stream_hourly_activity",
]


def run(query, spark, folder: str) -> float:
    began = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    for name in HEADLINE:
        run(queries[name], spark, folder)
    times = {name: round(min(run(queries[name], spark, folder) for _ in range(runs)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
