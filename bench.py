"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into a no-op sink (nothing is collected), once
to warm up and then three times; the median wall time is reported. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trace_summary", "requests_per_unit", "iops_mean_peak", "size_cdf_sampled", "size_p99",
    "block_access_counts", "access_histogram_log", "reuse_gap_requests", "all_reuse_volume",
    "reuse_stats", "first_reuse_segments", "first_arrival_rank", "device_features",
    "window_features", "hourly_series_filled", "load_trace_range",
    # the path of large traces (several order buckets), the heaviest operators, a sink and a model
    "reuse_gap_requests_bucketed", "all_reuse_volume_bucketed", "unique_reuse_distance", "split_by_device", "kmeans_devices",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE

    from iolens.queries import queries
    from iolens.session import get_session
    spark = get_session(f"local[{cpus}]", 2 * cpus, app="iolens-bench",
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()

    times = {}
    for n in names:
        def run():
            t0 = time.perf_counter()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        run()
        times[n] = round(statistics.median(run() for _ in range(reps)), 3)

    # CSV load throughput (comparable to the baseline's loader figure): the
    # dense trace is written once, untimed; the timed part parses and filters it.
    from iolens.session import scratch_path
    from iolens.sources import readers, views
    csv = scratch_path(spark, "bench-csv")
    views.trace_dense(spark, sf_dir).write.csv(csv)
    csv_rows = spark.read.csv(csv).count()

    def load():
        t0 = time.perf_counter()
        readers.load_trace_range(spark, csv, start="2019-12-31 16:00:00").write.format("noop") \
            .mode("overwrite").save()
        return time.perf_counter() - t0
    load()
    times["csv_load"] = round(statistics.median(load() for _ in range(reps)), 3)

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
        "trace_rows": rows,
    }
    out["csv_load_rows"] = csv_rows
    out["csv_load_rows_per_sec"] = round(csv_rows / times["csv_load"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
