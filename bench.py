"""Time the headline queries: one warm-up, then the median of a few runs each.

BENCH_SF_DIR   folder of the tables        (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session  (default 8)
BENCH_RUNS     timed runs per query        (default 3)
BENCH_QUERIES  comma-separated names       (default: the headline queries)
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from paceline.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "click_count_15s",
    "diagnostics_decode",
    "accepted_messages",
    "job_state",
    "latest_attempt",
    "bucket_max",
    "rolling_window",
    "window_stats",
    "evaluate_policies",
    "fold_with_resets",
    "first_enqueued",
    "issue_actions",
    "metric_flatten",
    "snapshot_messages",
    "stream_click_count",
    "stream_evaluate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
