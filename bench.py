"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all), BENCH_RUNS (default 3, the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from socklens import decode_records, read_records
from workload.registry import QUERIES, RECORD_FIELDS, record_files
from workload.session import local_session

HEADLINES = [
    "spec_events",
    "spec_sampled",
    "spec_with_geo",
    "field_math",
    "drop_filters",
    "json_payloads",
    "dynamic_rows",
    "typed_rows",
    "socket_sampling",
    "hot_socket_sampling",
    "geo_city_lookup",
    "geo_city_asn_lookup",
    "geo_full_lookup",
    "geo_full_lookup_shuffled",
    "event_json",
    "csv_lines",
    "table_rows_strict",
    "json_documents",
    "time_series_points",
    "line_protocol",
    "line_protocol_geo",
]


def stored_records(spark, sf_dir):
    """Decoders over record files, which are written outside the timing."""
    path, schema = record_files(spark, sf_dir)

    def decode(inet):
        return lambda *_: decode_records(read_records(spark, path, schema=schema).where(f"Inet = {inet}"), RECORD_FIELDS, inet)

    return {"stored_ipv4_records": decode(4), "stored_ipv6_records": decode(6)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    timed = {**{name: QUERIES[name] for name in HEADLINES}, **stored_records(spark, sf_dir)}
    for name, run in timed.items():
        best = None
        for _ in range(runs):
            begun = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begun
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "events": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
