"""Benchmark: run every registered catalog query and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_REPEAT`` (default 2; the best run per query is reported).
Each query is executed in full with the ``noop`` sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]

    from tectonic.session import local_session
    from tectonic.suite import QUERIES

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # warm the JVM and the file listing cache once
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in only or sorted(QUERIES):
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
