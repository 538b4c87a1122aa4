"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidelog.plans import registry

HEADLINE = [
    "backfill_window", "shard_union", "merge_min_watermark", "prefix_hole", "log_accept", "renumber", "renumber_then_filter", "frame_filter", "wire_runs", "ring_retention", "layout_route", "key_at_asof", "accepts", "history_check", "topology_merge",
    "lease_classify", "quorum_verdict", "component_classify", "put_delete_effects", "storage_fold", "window_side", "observed_total", "request_rollup", "latency_histogram", "gauge_shares", "lsm_totals", "map_lookup", "inuse_by_function", "segment_roundtrip",
]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    name = os.path.basename(data.rstrip("/")).removeprefix("sf")
    sf = float(name) if name.replace(".", "", 1).isdigit() else name
    took = {}
    for query in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            registry.QUERIES[query](spark, data).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[query] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
