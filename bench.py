"""Times the headline queries: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS; one warm-up, then the median of three."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "mentions_monthly", "couple_stats", "row_features", "tukey_fence_by_couple", "zscore_medium", "zscore_short", "top_anomalies", "cluster_fusion", "cascaded_dates", "seed_terms", "lexical_terms", "dosages",
    "quality_flags", "alert_levels", "hits_sources", "upsert_last_wins", "insert_first_wins", "monographs", "articles", "normalised_records", "isolation_forest", "kmeans_clusters", "local_outliers",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from signalforge import catalog

    found, times = catalog.queries(), {}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in [n for n in sys.argv[1:] or HEADLINE if n in found]:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
