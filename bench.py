"""Time the headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads. Every query runs
to the end over its whole tables into a sink that discards the rows. The token
index is built once (``build_index`` and ``index_store`` time that, ``substring_store``
the index of character runs) and then
read by the searches, as in a running archive.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "build_threads", "w_dedupe_first", "participants", "j_thread_messages", "thread_content",
    "strip_html", "build_index", "search_and", "search_or", "search_phrase", "search_nearly_all", "search_substring",
    "search_total", "multi_query", "merge_results", "round_summary", "match_subjects",
    "upsert_threads", "import_merge", "j_changed_threads", "j_legacy_claim", "usage_by_user",
    "spend_limit", "kv_latest", "batch_ledger", "clean_tags", "parse_tags", "retag_empty",
    "w_tag_groups", "scan_status", "change_stream",
]
LATENCY_RUNS = 30


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from threadlens.plans.queries import QUERIES
    from threadlens.plans.common import doc_index, doc_substrings
    from threadlens.session import builder

    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # Start the JVM's compiled paths once, on the smallest table.
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    seconds = {}
    if any(n.startswith(("search", "multi", "merge", "round")) for n in names):
        start = time.perf_counter()
        doc_index(spark, sf_dir)
        seconds["index_store"] = round(time.perf_counter() - start, 3)
    if "search_substring" in names:
        start = time.perf_counter()
        doc_substrings(spark, sf_dir)
        seconds["substring_store"] = round(time.perf_counter() - start, 3)
    for name in names:
        seconds[name] = round(run(name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "search_and" in names:
        times = sorted(run("search_and") for _ in range(LATENCY_RUNS))
        result["search_latency"] = {
            "p50": round(statistics.median(times), 3),
            "p95": round(times[min(len(times) - 1, int(0.95 * len(times)))], 3),
            "runs": LATENCY_RUNS,
        }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
