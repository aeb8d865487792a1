"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time


from checks.queries import callables
from tidewatch.session import builder

HEADLINE = [
    "state_evaluation",
    "monthly_report",
    "daily_uptime",
    "run_anomalies",
    "run_pairs",
    "call_buckets",
    "job_cost_per_day",
    "cost_spikes",
    "file_arrivals",
    "alert_decisions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    known = callables()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            # everything is computed, nothing is brought to the driver
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        # the first run warms up
        seconds[name] = round(sorted(times[1:])[repeats // 2], 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "events": rows,
            }
        )
    )


if __name__ == "__main__":
    main()
