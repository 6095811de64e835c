"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads, ``BENCH_RUNS``
the timed runs per query (the median counts; one warm-up run of the first query
starts the session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidegrid.queries import load
from tidegrid.session import get_session, remove_stages

HEADLINE = (
    "flagship_gap_safe_fill", "a02_csv_load", "b09_first_per_timestamp", "c02_resample_mean", "c03_role_resample", "d01_weather_exact_join",
    "d02_nearest_join", "e02_missing_periods", "e17_quality_checks", "f05_fill_masks", "g02_iqr_flags", "g09_combined_flags", "h08_rolling_means",
    "h10_control_features", "h16_ewma_smoothing", "i01_describe", "i10_weekly_aggregates", "i18_load_duration", "i20_welch_t_test", "j01_pearson",
    "j02_spearman", "j09_lag_correlation", "k01_sliding_windows", "l06_dynamic_threshold", "l14_severity", "l17_events", "m04_linear_regression",
)

#: Seconds after which each query is timed once only.
BUDGET_S = 300


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES

    def once(name: str) -> float:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t
        remove_stages(spark)
        return took

    names = names or list(HEADLINE)
    once(names[0])
    times, began = {}, time.perf_counter()
    for n in names:
        own = [once(n)]
        # further runs as long as the whole stays within its time
        while len(own) < runs and time.perf_counter() - began < BUDGET_S:
            own.append(once(n))
        times[n] = round(statistics.median(own), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
