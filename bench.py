"""Wall-clock of the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES an optional
comma-separated subset, BENCH_WARMUP=0 skips the warm-up run on the smallest tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from volarium.plans.catalog import CATALOG
from volarium.session import local_session

HEADLINE = [
    "har_forecast_losses", "feature_panel", "log_returns_by_day", "realised_variance", "exact_percentiles",
    "neighbour_features", "graph_feature_panel", "return_correlations", "linear_tournament", "rolling_har",
    "rolling_graph_har", "graph_study", "regime_losses", "residual_statistics", "confidence_set_by_ticker",
    "confidence_set_by_date", "effect_decomposition", "score_gnn_2l", "sparse_precision_graph", "network_fits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    names = list(CATALOG) if names == ["all"] else names
    spark = local_session(cores, "volarium-bench")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BENCH_WARMUP", "1") != "0":
        small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
        if os.path.isdir(small):  # start the JVM's and Python workers' code paths, not timed
            for name in ("har_forecast_losses", "return_correlations"):
                CATALOG[name].run(spark, small).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in names:
        at = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - at, 3)
        print(f"{name}: {spent[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall-clock of the headline queries", "value": round(sum(spent.values()), 3),
                      "unit": "sec", "queries": spent, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
