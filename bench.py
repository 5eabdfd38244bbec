"""Seconds per headline query: one warm-up, then the median of three runs. Prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS change the data, the cores and the number of timed runs;
query names as arguments restrict the list.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

from undula.plans import all_queries  # noqa: E402

HEADLINE = [
    "a21_zscore_by_region",
    "b1_fc_pearson",
    "b4_sliding_dfc",
    "b5_window_sweep",
    "b7_fcd",
    "c1_pearson_speed",
    "c2_spearman_speed",
    "c4_unified_median_speed",
    "c6_tau_split_speed",
    "c11_community_speed",
    "d4_population_pooling",
    "d10_empirical_cdf",
    "d11_group_quantiles",
    "e1_mann_whitney",
    "e8_theil_sen",
    "f1_meta_connectivity",
    "f9_trimer_prevalence_by_group",
    "g4_contingency_levels",
    "g14_mean_nmi",
    "h8_activation_events",
    "i2_fluidity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("undula-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-bench-"))
    queries = all_queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}s (first {times[0]:.1f}s)", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
