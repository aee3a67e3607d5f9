"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_RUNS     timed runs per query; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidewharf.session import local_session
from tidewharf.workload import WORKLOAD


def scale(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir.rstrip("/"))
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(WORKLOAD)
    spark = local_session(cpus, "bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        WORKLOAD[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names[:3]:  # start the JIT and the file-system caches
        run(name)
    seconds = {
        name: round(statistics.median(run(name) for _ in range(runs)), 4) for name in names
    }
    print(json.dumps({
        "metric": "workload_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": scale(sf_dir),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
