"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.registry import build
from leaksieve.session import local_session

HEADLINE = (
    "scan_documents_std",
    "scan_documents_ext",
    "scan_pages_std",
    "scan_pages_ext",
    "scan_stream",
    "literal_search",
    "scan_custom_domains",
    "clean_duplicates",
    "equal_duplicate_pairs",
    "severity_type_counts",
    "run_stats",
    "incremental_scan",
    "scan_family_credentials",
    "scan_family_financial",
    "extract_links",
    "filter_links",
    "crawl_depth",
    "page_file_name",
    "normalized_hash",
    "unescape_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = build()
    # One untimed run of the first query, so that the start of the JVM is in no query's time.
    queries[HEADLINE[0]][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        query, _ = queries[name]
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
