"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully materialised through the ``noop`` writer (no collect to the
driver); the reported time per query is the best of ``BENCH_REPEAT`` runs after
one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cip", "select_round_robin", "code_metrics", "cognitive", "clean_code", "embed_text",
    "topk_similar", "kth_neighbour_distance", "silhouette_euclidean", "optimal_eps",
    "extract_methods", "strip_to_interactions", "covariance", "cluster_profile", "hist_nesting",
    "ann_topk", "dbscan_search", "kmeans", "pca_2d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from culler.plans.registry import load_all
    from culler.session import get_spark

    spark = get_spark(cpus, app="culler-bench", shuffle_partitions=max(8, int(cpus) * 2))
    qs = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        best = None
        for _ in range(repeat):
            t0 = time.time()
            qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
