"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Each query is written to the no-op sink after one
warm-up run; its time is the median of the later runs (BENCH_RUNS, default 1),
query building included. The search queries share an index that the warm-up run
writes; ``bm25_vocabulary_path`` writes its own in each run, so it holds that cost.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from orderwatch.plans import QUERIES
from orderwatch.session import build_session

HEADLINE = (
    "orders_enriched",
    "seller_delivery_metrics",
    "review_risk_metrics",
    "product_quality_metrics",
    "top_risky_sellers",
    "seller_profile",
    "category_quality_risk",
    "product_tier_price_band",
    "seller_week_trend",
    "auto_tasks",
    "task_creation",
    "doc_chunks",
    "page_elements",
    "bm25_topk",
    "bm25_with_fallback",
    "substring_search",
    "bm25_vocabulary_path",
    "intent_labels",
    "json_block",
    "eval_by_group",
)


def measure(spark, folder: str, name: str, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return statistics.median(times[1:])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries = {name: round(measure(spark, folder, name, runs), 3) for name in HEADLINE}
    total = round(sum(queries.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": queries, "sf": scale}))


if __name__ == "__main__":
    main()
