"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetwright.registry import QUERIES  # noqa: E402
from fleetwright.session import build_session, remove_stored  # noqa: E402

HEADLINE = [
    "z1_size_fleet", "z1_size_fleet_overridden", "z3_what_if", "p5_apply_overrides", "u8_fleet_rollup",
    "r1_evaluate_warnings", "r4_edge_alerts", "r6_muted_alerts", "r7_tuning_hints", "a2_reservation_profile",
    "a3_remaining_pool", "n1_materialise_jobs", "n2_balance_shares", "n3_apportion_export",
    "n4_finalise_allocs", "a5_capacity_summary", "x1_pool_segments", "x4_job_trace", "t4_render_text",
    "t4_render_job_text", "s5_plan_documents", "s6_report_tables", "v1_debounce", "v4_usage_windows",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        # Small inputs with much work per row: keep the cores busy after a shuffle.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for _ in range(4):  # a cold JVM would be charged to whichever query comes first
        QUERIES["u1_utilisation"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The first run warms code generation and the file cache.
        timings[name] = round(statistics.median(runs[1:]), 3)
    # The same once more under Spark's default for small partitions, which suits large inputs.
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1m")
    start = time.perf_counter()
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    by_default = time.perf_counter() - start
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "total_with_default_partition_size": round(by_default, 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    remove_stored(spark)
    spark.stop()


if __name__ == "__main__":
    main()
