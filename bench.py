"""Times every named query: prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores; name parts given as
arguments restrict the run.  Each query is written to the no-op sink, so all of its
columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from launchsift.plans import catalogue
from launchsift.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(query, spark) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    parts = sys.argv[1:]
    spark = local_session(CPUS, "launchsift-bench")
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_partkey").count().write.format(
        "noop"
    ).mode("overwrite").save()
    times = {}
    for query in catalogue.all_queries():
        if parts and not any(p in query.name for p in parts):
            continue
        times[query.name] = round(timed(query, spark), 3)
        print(f"{query.name} {times[query.name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall seconds of all named queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(FOLDER.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
