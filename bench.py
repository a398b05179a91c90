"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from handspan.plans.registry import QUERIES

HEADLINE = (
    "key_predicates", "lattice_ngrams", "chord_counts", "tempo_features", "sounding_at_onset", "features_v7", "explode_abcdf", "confusion", "alpha_trigram", "match_rates",
    "gold_votes", "rule_costs", "segment_cost_parncutt", "tau_relaxed", "expected_reciprocal_rank", "transition_weights", "advise_parncutt", "strike_reentry", "rank_tags", "err_tags", "evaluate_model",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    control = []
    for _ in range(4):  # a fixed piece of work of Spark's own, so that rounds on different machines compare
        start = time.time()
        spark.range(200_000_000).selectExpr("sum(xxhash64(id) % 1000) AS s").write.format("noop").mode("overwrite").save()
        control.append(time.time() - start)
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "control": round(statistics.median(control[1:]), 3)}))


if __name__ == "__main__":
    main()
