"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from probatum.plans import catalog
from probatum.session import local_session

HEADLINE = [
    "parsed_cells", "parse_issues", "domain_violations", "field_checks", "exclusions_out_of_range",
    "normalized_duplicate_rows", "duplicate_group_sizes", "dense_group_ids", "label_conflicts",
    "near_duplicate_totals", "near_duplicate_degrees", "feature_label_purity", "mean_abs_correlation",
    "dump_cell_kinds", "dump_multiset_summary", "stratified_folds", "fold_audit", "grouped_folds_isolation",
    "train_statistics", "fold_scores", "repeat_summary", "persistent_errors", "single_feature_scores",
    "nested_single_predictions", "permutation_scores", "logistic_scores",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "probatum-bench")
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["balance_bands"](spark, sf).write.format("noop").mode("overwrite").save()  # session warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
