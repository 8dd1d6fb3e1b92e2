"""Headline queries at one scale: prints one JSON line. Each is warmed once, then timed three times into the noop sink;
the median is reported."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tilewright.plans import all_queries  # noqa: E402
from tilewright.plans import roles  # noqa: E402
from tilewright.session import local_session  # noqa: E402

HEADLINE = [
    "prototype_assignment",
    "prototype_composition",
    "knn_pairs",
    "radius_edges",
    "interface_density",
    "transition_matrix",
    "weighted_cell_expression",
    "pseudobulk_means",
    "log_normalised_counts",
    "welch_test",
    "mann_whitney_all_and_cohort",
    "auc_with_interval",
    "kaplan_meier_curves",
    "concordance_index",
    "rank_signature_scores",
    "prototype_calls",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cores, name="bench", shuffle=cores)
    known, times = all_queries(), {}
    for name in HEADLINE:
        spent = []
        for i in range(runs + 1):
            roles._staged.clear()  # shared stages are part of the measured work
            t0 = time.perf_counter()
            known[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                spent.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(spent), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median wall times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "spark": spark.version,
                "cores": int(cores),
                "shuffle_partitions": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
