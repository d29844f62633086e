"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "catalog",
    "search_faceted",
    "search_sorted_title_asc",
    "search_page",
    "book_detail",
    "migrate_books",
    "cart_view",
    "cart_compact",
    "cart_add",
    "cart_fold",
    "checkout_orders",
    "order_history",
    "order_items_with_cover",
    "order_charges",
    "recent_purchases",
    "order_totals_recalc",
    "order_item_qty_update",
    "order_delete_outcome",
    "update_profiles",
    "fk_orphans",
    "dq_unique",
    "request_latency",
    "quota_by_window",
    "quota_excess_requests",
    "stream_quota",
)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quire-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quire.plans.queries import QUERIES
    from quire.sources import scratch

    scratch.use_if_unset(spark, "/tmp/checkpoints/quire-bench")
    spark.read.parquet(f"{base}/lineitem.parquet").count()  # start the workers
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        begin = time.perf_counter()
        QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        scratch.clear(spark)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(base.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
