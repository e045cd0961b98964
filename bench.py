"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]``.
Each query runs once untimed and then ``BENCH_RUNS`` times; the best time counts.
Results go to a sink that reads every row and keeps none.
"""

from __future__ import annotations

import json
import os
import time

from tidemark import build_session
from tidemark.workload.registry import load_all

HEADLINE = [
    "Q2_rollup_hourly",
    "Q2_rollup_daily_facts",
    "Q3_error_rate",
    "Q4_service_health",
    "Q5_ingestion_delay_exact",
    "Q5_ingestion_delay_sketch",
    "Q6_latest_by",
    "Q7_count_cardinality",
    "Q10_make_series",
    "Q12_project_paths",
    "Q13_text_filter",
    "Q14_union_fuzzy",
    "V2_stitched_rollup",
    "V3_reaggregate",
    "V4_trace_spans",
    "A1_increase",
    "A2_rate",
    "A4_counter_totals",
    "F1_filter_metrics_default_drop",
    "F5_enrich_labels",
    "F7_sort_labels",
    "F8_series_id",
    "F9_lift_labels",
    "F13_route_metrics",
    "S1_prometheus_text",
    "S4_flatten_otlp_metrics",
    "S5_flatten_otlp_logs",
    "S6_container_lines",
    "S10_spans_to_logs",
    "L2_encode_native_logs",
    "L6_parse_messages",
    "L8_keyvalue_body",
    "L11_reassemble_lines",
    "L12_route_logs",
    "L14_enrich_pods",
    "W2_missing_windows",
    "W4_run_rollup",
    "W7_rule_health",
    "N2_to_notifications",
    "N5_throttle",
    "N6_correlate",
    "X1_to_metrics",
    "X7_to_series",
    "K1_write_routed",
    "K3_write_layout",
    "K7_otlp_gauges",
    "K8_group_by_tag",
    "metrics_ingest_path",
    "T1_stream_rollup",
    "T4_stream_increase",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = build_session(
        "tidemark-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    times = {}
    for name in only or HEADLINE:
        best = None
        for attempt in range(runs + 1):
            started = time.perf_counter()
            registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if attempt and (best is None or took < best):
                best = took
        times[name] = round(best, 4)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
