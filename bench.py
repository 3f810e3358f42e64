"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs to
completion into the no-op sink, so every result column of every row is computed. A first
untimed query warms the JVM; then each query runs twice and the better time counts.
"""

from __future__ import annotations

import json
import os
import time

from quayside.catalogue import QUERIES
from quayside.session import build_session

HEADLINE = [
    "zone_report_counts", "zone_lineitems", "zone_match_documents", "zone_match_rules", "records_full_view",
    "record_counts_left", "anti_cascade", "selected_or_all", "grid_stats", "nested_children", "key_superset",
    "preview_keys", "backfill_long", "normalise_keys", "alias_cells", "active_columns", "zone_html", "reply_roundtrip",
    "attempt_resolution", "retry_failed", "request_text", "html_to_text", "html_word_count", "rfc_date_parse",
    "first_n_children", "numbered_lineitems", "inbox", "merge_by_key", "apply_edits", "integrity_report",
    "latest_status", "terminal_jobs", "running_totals", "recent_log_per_job", "message_parts", "stream_latest_status",
    "report_documents", "normalise_flow", "grid_stats_columns", "zone_match_equality", "superset_rows", "stream_recent_log",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])
    times = {name: round(min(run(name), run(name)), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
