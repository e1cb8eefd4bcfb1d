"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is run to a `noop` sink (everything is computed, nothing is collected): once to warm up,
then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from opsframe.catalog import QUERIES
from opsframe.catalog.flagship import order_page
from opsframe.plans.session import build_session

HEADLINE = [
    "a1_group_by", "a3_frequencies", "a4_batches", "a5_unique_by", "a11_play_summary", "a12_response_times",
    "c2_report_format", "c9_traffic", "f3_safe_map", "g1_user_graph", "g3_metric_and_path", "g6_flow_table",
    "h3_shard_read", "j2_fk_path_join", "j3_nested_embed", "j9_subnet_join", "j10_learned_port", "j11_snapshot_diff",
    "l3_page", "l3_deep_page", "p9_lookup_filters", "p12_search_partial", "s5_severity_routing", "s7_json_export",
    "s10_insert_or_ignore", "s13_cascade_delete", "s16_host_facts", "t1_tail_tag_route", "t2_streaming_rates",
    "t3_liveness_stream", "t4_location_changes", "w1_counter_rates", "w5_disk_rates", "w8_alerts", "w11_audit_summary", "w12_commands",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def once(fn) -> float:
        started = time.perf_counter()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    jobs = {"flagship_order_page": order_page} | {n: QUERIES[n] for n in HEADLINE}
    times = {}
    for name, fn in jobs.items():
        once(fn)
        times[name] = round(statistics.median(once(fn) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
                      "spark": spark.version, "runs": runs}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
