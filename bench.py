"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2:
the better run counts), BENCH_ONLY (comma-separated names; "all" for every query).
"""

from __future__ import annotations

import json
import os
import time

from lotlens.plans import catalog
from lotlens.session import local_session

HEADLINE = [
    "market_sale_by_district", "market_all_cohorts", "gross_yield", "active_inventory", "effective_rates", "below_market_hints",
    "change_events", "price_drop_counts", "merged_listings", "missing_listings", "premises_vanish_events",
    "deal_scores", "hypotheses_merged", "activity_summary", "seller_stress", "price_drop_listings",
    "first_page_of_each_sort", "portal_spreads", "annotated_listings", "saved_filter_matches", "price_audit",
    "fingerprints", "segments_of_documents", "prices_normalized", "total_prices_from_text", "cards_from_json_ld", "stream_daily_activity",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY", "")
    names = list(catalog.QUERIES) if only == "all" else [n for n in only.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="12g")
    spark.read.parquet(f"{root}/orders.parquet").groupBy("o_orderpriority").count().collect()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
