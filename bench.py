"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from panelspark.plans.catalog import QUERIES
from panelspark.session import local_session

# the stages of the reference workload: ingest and dedup, relevance, index, gaps, returns, regressions, tests
HEADLINE = (
    "exact_dedup hash_dedup purge_failures_and_duplicates firm_year_matrix relevance_scoring threshold_sweep target_split "
    "near_duplicate_survivors panel_structure stance_distribution daily_index weekly_stance_index gap_imputation coverage_threshold "
    "weekly_returns alignment_counts return_panel stance_model_firm_effects event_study did_stance_absorbed synthetic_control_did "
    "adf_tests var_diagnostics granger_tests panel_granger_tests"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "panelspark-bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    took = {}
    for name in names:
        start = time.perf_counter()
        # every row and column is produced, nothing is written
        QUERIES[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name:40s} {took[name]:8.2f}", file=sys.stderr, flush=True)
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"))
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
