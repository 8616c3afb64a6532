"""Seconds per registered query: median of BENCH_RUNS runs after a warm-up. Prints one JSON line.

Queries that take longer than SLOW seconds are timed once after their warm-up, and once BENCH_BUDGET seconds have gone the
remaining queries are run once only; ``once`` names the latter, whose times include compilation.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from opsloom.plans.registry import QUERIES  # noqa: E402
from opsloom.session import build_session  # noqa: E402

SLOW = 5.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "420"))
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, once = {}, []
    begin = time.perf_counter()
    for name in names:
        def run() -> float:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        late = time.perf_counter() - begin > budget
        first = run()
        if late:
            once.append(name)
            times = [first]
        else:
            times = [run() for _ in range(runs if first < SLOW else 1)]
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {
        q: round(events / seconds[q]) for q in ("tail_queue_dedup", "metric_stat_stream") if q in seconds
    }
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per query",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": scale,
                "cpus": int(cpus),
                "events_per_second": rates,
                "once": once,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
