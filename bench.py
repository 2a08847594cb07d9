"""Wall time of the registered queries; prints one JSON line.

BENCH_SF_DIR   folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     runs per query, the best counts (default 1)
BENCH_QUERIES  comma-separated names (default: all but the end-to-end loads, whose
               time is that of some hundred small jobs; name them to time them)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfline.plans import load_registry  # noqa: E402
from shelfline.plans.load_queries import END_TO_END  # noqa: E402
from shelfline.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries, _ = load_registry()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    names = names or [n for n in queries if n not in END_TO_END]
    spark = local_session(cores, "shelfline-bench", partitions=int(cores))
    # Start the JVM's and the Parquet reader's machinery before the clock.
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
        "cpus": int(cores),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
