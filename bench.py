"""Time the headline queries and print one JSON line.

Each query is planned and run to the end twice, into a sink that discards rows; the faster run counts, so the first
run's code generation is left out. Neighborhoods are fitted anew for every run of ``neighborhood_assignments``, and kept for
the queries after it. BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from placebeat.checks.queries import QUERIES, forget_neighborhoods

HEADLINE = (
    "enriched_events", "cleaned_reviews", "event_categories", "event_grid_cells", "city_metrics",
    "city_metrics_volume", "grid_hotspots", "grid_hotspots_volume", "category_leaders", "latest_reviews",
    "dense_city_counts", "window_hotspots", "window_hotspots_tumbling", "window_hotspots_volume", "emerging_areas",
    "city_activity_windows", "city_activity_minutely", "category_mix", "neighborhood_assignments", "neighborhood_hotspots", "city_window_hotspots", "top_categories_by_area",
    "activity_series_thinned", "city_leaderboard",
)
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("placebeat-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            if name == "neighborhood_assignments":
                forget_neighborhoods()
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    version = spark.version
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "seconds for all headline queries, better of two runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": version,
            }
        )
    )


if __name__ == "__main__":
    main()
