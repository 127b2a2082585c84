"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm the JVM, then BENCH_RUNS times; the median counts. Results
are written to the no-op sink, so every row is produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from procura.session import build_session

HEADLINE = [
    "current_offers",
    "best_offer_per_item",
    "top20_alternatives",
    "supplier_order_lines",
    "extract_attributes",
    "match_decisions",
    "fuzzy_match",
    "subset_match",
    "dedup_offers",
    "offer_upsert",
    "warehouse_snapshot",
    "request_lines",
    "product_search",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("OFF")
    from procura.plans.registry import QUERIES

    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(took[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
