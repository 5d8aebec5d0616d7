"""Times the headline queries and prints one JSON line.

Each query runs once to warm up code generation and file listings, then once
timed, with its result written to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from trustlake.plans.catalog import QUERIES
from trustlake.session import configure

HEADLINE = [
    "met_all",
    "met_license",
    "met_performance_claims",
    "met_dataset_quality",
    "met_size_score",
    "met_code_quality",
    "met_reviewedness",
    "met_reproducibility",
    "agg_net_score",
    "flt_admission_gate",
    "prj_rating_view",
    "agg_reviewedness",
    "agg_total_weight_bytes",
    "agg_log_counts",
    "agg_latency_pctl_latest",
    "win_recent_errors",
    "win_running_cap",
    "join_patterns_theta",
    "join_keywords",
    "join_readme_name",
    "snk_upsert_registry",
    "e2e_list",
    "e2e_search",
    "e2e_health",
    "e2e_rate_and_register",
    "stream_health",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trustlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    )
    spark = configure(builder, int(cpus)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
