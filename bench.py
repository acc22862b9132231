"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from weftline.plans import QUERIES  # noqa: E402

HEADLINE = (
    "flagship_cost_centres", "scan_csv", "incremental_fetch", "xml_children", "attributes_map",
    "sink_update", "fan_out_routes", "nest_packet", "expression_select", "router", "reject_rows",
    "joiner_left", "lookup", "lookup_composite", "lookup_unmatched", "rule_lookup",
    "nearest_neighbour", "review_override", "substring_link", "aggregator", "confidence_score",
    "complexity_band", "rank_global", "rank_partitioned", "sequence", "sorter", "top_k",
    "normalizer", "split_records", "fn_decode", "fn_to_date", "fn_trunc_num", "conform_schema",
    "pattern_scan", "rewrite_chain", "tiered_match", "feedback_rules", "topo_levels",
    "validation_report", "heal_links", "stream_router", "custom_rows",
)
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in HEADLINE if not only else (QUERIES if only == ["all"] else only):
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline queries, median of two warm runs each, summed", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
