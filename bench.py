"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innsight.functions.frames import drop_staged  # noqa: E402
from innsight.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "a3_gap_to_cluster", "a4_trend", "t9_label_reviews", "a1_units_from_arrays",
    "b5_benchmark", "b5_benchmark_by_region", "c6_changepoints", "c6_changepoints_by_region",
    "m7_market_patterns", "g10_permutation_scan", "f6_fix_check_grid", "s1_market_scope",
    "s3_priority_actions", "s5_destination", "x1_search", "e4_aspect_scores", "l2_corpus",
    "i4_cross_file_repeats", "st1_label_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("innsight-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="innsight-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    drop_staged(spark)
    print(json.dumps({
        "metric": "innsight headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
