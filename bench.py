"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores.

Each figure is the median of three runs; another round isn't begun after BUDGET seconds.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tidemark.plans.queries import QUERIES

HEADLINE = ["daily_bars", "quality_report", "asof_backward", "technical_features", "recursive_features", "graph_adjacency", "graph_features", "tournament", "conformal_sets", "adaptive_conformal", "model_mixture", "backtest_metrics", "tail_risk", "hmm_filter", "gibbs_convergence", "deep_ensemble", "online_scores"]

BUDGET = 200


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["daily_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    began, times = time.perf_counter(), {name: [] for name in HEADLINE}
    for _ in range(3):
        if any(times.values()) and time.perf_counter() - began > BUDGET:
            break
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - start)
    took = {name: round(median(t), 3) for name, t in times.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
