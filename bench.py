"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from fleetlife.plans.registry import QUERIES
from fleetlife.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "drive_summary",
    "labels",
    "label_balance",
    "fleet_kpis",
    "rolling_mean",
    "rolling_std",
    "rolling_features_train",
    "survival_table",
    "latest_snapshot",
    "undersample",
    "sample_n",
    "drift_numeric",
    "drift_report",
    "rank_curve",
    "classification_bundle",
    "c_index",
    "sequence_windows",
    "request_features",
    "top_reasons",
    "score_split",
    "fleet_scorecard",
]


def main() -> None:
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and the Parquet reader before the clock.
    spark.read.parquet(f"{SF_DIR}/nation.parquet").groupBy("n_regionkey").count().collect()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
