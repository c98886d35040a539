"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from stratawell.plans.catalogue import QUERIES
from stratawell.session import local_session

#: One or more queries of each family that scale with the tables; the seconds are the second run's.
HEADLINE = [
    "feature_response_corr", "feature_corr_two_level", "partial_corr", "spearman_corr", "topn_features_abs_median", "share_per_million",
    "gene_style_sum", "adjusted_dispersion", "list_min_max_per_key", "update_join_overwrite", "candidate_rotations", "interval_overlap",
    "interval_within_gap", "interval_signal_summary", "point_in_interval", "event_id_parse", "wide_to_long", "long_to_wide", "running_total",
    "fdr_adjust", "zscore_train", "auroc_rank", "regression_metrics_two_level", "nested_f_statistic", "stable_row_id", "explode_distinct_attach", "psi_ratio",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "bench")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
