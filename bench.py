"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.plans import catalog  # noqa: E402
from millrace.session import get_session  # noqa: E402

HEADLINE = [
    "quality_suite", "schema_contract_violations", "null_thresholds", "duplicate_fraction", "robust_outliers", "numeric_profile",
    "categorical_profile", "group_median", "ks_two_sample", "wasserstein_normalized", "js_distance", "temporal_split",
    "stratified_split", "stratified_kfold", "target_mean_encoding", "engineered_features", "one_hot_categories", "anova_f_scores",
    "roc_auc", "average_precision", "threshold_sweep", "subgroup_metrics", "score_decision", "windowed_rate", "windowed_quantiles",
    "stream_scoring", "undersample_bags", "train_random_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["value_shares"](spark, sf_dir).collect()  # start the session's workers
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
