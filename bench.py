"""Times the headline queries and prints one JSON line.

Each query is planned and run in full (noop sink: every row and column is computed, none collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from mirepoix.plans.catalog import QUERIES

HEADLINE = (
    "propagation_predict",
    "evaluation_report",
    "similarity_table",
    "ingredient_profile",
    "nutrition_profile_avg",
    "ingredient_pmi",
    "ingredient_graph",
    "valid_recipes",
    "user_stats",
    "activity_curve",
    "author_activity",
    "type_split",
    "quota_split",
    "percent_split",
    "dedupe_reviews",
    "exclusive_interactions",
    "regression_metrics",
    "confusion_metrics",
    "precision_at_k",
    "ingredient_names",
    "difficulty_corr",
    "difficulty_tree",
)

# run once untimed, so that class loading and compilation are not charged to the first query
WARM_UP = ("user_stats", "propagation_predict")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mirepoix-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        # one shuffle partition per core: merging them further would leave cores idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
