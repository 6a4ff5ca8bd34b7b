"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores),
BENCH_RUNS (timed runs per query after one warm-up; the median is reported).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.registry.queries import QUERIES  # noqa: E402
from plumbline.session import local_session, ship_package  # noqa: E402

HEADLINE = [
    "ts_ceil_15",
    "round_two_grids",
    "feature_lookup",
    "size_exact",
    "is_oversized",
    "reduce_sample_by_key",
    "reduce_limit_ordered",
    "scan_csv",
    "csv_roundtrip",
    "route_over",
    "route_forced",
    "save_partitioned",
    "export_roundtrip",
    "provision_counts",
    "profile_overview",
    "profile_overview_text",
    "profile_missing",
    "profile_numeric",
    "profile_quantiles",
    "profile_quantiles_approx",
    "profile_topk",
    "profile_histogram",
    "profile_correlation",
    "pair_bins",
    "profile_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
