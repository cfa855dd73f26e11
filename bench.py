"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "table_bloat", "unused_indexes", "missing_indexes", "slow_queries", "parameter_settings",
    "statement_summary", "snapshot_metrics", "snapshot_metrics_by_database",
    "parameter_changes", "consecutive_metric_changes", "compare_metrics_join", "timeline_stats",
    "latest_per_check", "stale_checks", "store_counts",
    "flatten_plan", "plan_metrics", "plan_issues", "score_executions",
    "execution_regressions", "metrics_table", "plan_node_diff", "execution_query_join",
    "result_column_stats", "cell_class_profile", "read_only_audit", "name_dedup",
    "stream_snapshot_windows", "stream_parameter_changes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        # No call-site capture for every Column of the long projections.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from fleetpulse.session import configure
    from registry.catalogue import QUERIES

    configure(spark)
    chosen = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in chosen:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
