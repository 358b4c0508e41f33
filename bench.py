"""Benchmark: one JSON line with the seconds of each headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from evalloom.plans.catalogue import QUERIES

HEADLINE = (
    "paired_run_compare", "case_regressions_topk", "check_deltas_full_outer", "step_timing_p50_p95", "progress_status",
    "trust_tier_summary", "redact_documents", "word_ngram_counts", "leakage_ngrams", "bm25_topk", "user_intent_text",
    "attribution_by_step", "severity_weighted_judge", "trajectory_ordering", "stratified_split", "connected_groups",
    "bootstrap_improvement", "pareto_frontier", "pattern_consolidation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's start is not measured
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(line))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
