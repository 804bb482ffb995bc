"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line. Each query runs to completion through the noop sink
(full execution, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from offerflow.plans.registry import QUERIES  # noqa: E402
from offerflow.session import local_session  # noqa: E402

HEADLINE = [
    "flagship", "match_words", "match_profiles", "dedupe_batch", "merge_history", "incremental_run",
    "newest_per_site", "score_offers", "report_html", "site_funnel", "search_plan", "page_links",
    "longest_block", "page_cards", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="offerflow-bench")
    # warm up the JVM and the Python workers on a small query
    QUERIES["page_links"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
