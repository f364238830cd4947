"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (a comma list) choose the data, the
cores and the queries. Each query is run to its last row into a sink that
discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidewatch.plans import QUERIES
from tidewatch.session import local_session


def run(spark, name, folder):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidewatch-bench")
    run(spark, "service_volume", folder)
    seconds, failed = {}, {}
    for name in names:
        try:
            seconds[name] = round(run(spark, name, folder), 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = str(error).splitlines()[0][:200]
        print(f"{name} {seconds.get(name, 'failed')}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    line = {"metric": "all queries, one run each", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}
    print(json.dumps(line | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
