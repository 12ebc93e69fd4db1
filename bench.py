"""Time of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from solfa.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: clean_summary cleans the whole catalogue; the queries after duplicate_flags read the stored result of one cleaning.
HEADLINE = [
    "clean_summary", "clean_issues", "duplicate_flags", "column_profile", "top_values", "quality_score", "value_filter",
    "sorted_page", "master_upsert", "master_conflicts", "royalty_shares", "royalty_slots", "royalty_wide", "writer_rows",
    "packed_explode", "similar_values", "similar_counts", "activity_sessions", "branch_rollup", "documents_exact_dups",
    "overlay_issues", "review_chain", "master_snapshot", "royalty_checks",
]


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .getOrCreate()
    )


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)$", SF_DIR)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
