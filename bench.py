"""Benchmark every query of the reference's operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query runs twice on ``BENCH_SF_DIR``, forced to completion with the
``noop`` sink, in one session; nothing is kept between runs, so both read the
tables. ``queries`` has the first run, ``second_run`` the second, when code is
compiled. The boosted-tree queries (600 trees, minutes each) run once. A
query's time includes the driver actions it takes while being built (mask
count, split cut search, model fit) and its own stored copies. Prints one JSON
line ``{"metric", "value", "unit", "queries", "second_run", "sf"}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

ONCE = {"gbt_holdout_metrics", "gbt_scored_requests", "gbt_profile_24h"}


def main() -> None:
    from farebox.plans import QUERIES
    from farebox.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(QUERIES)
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g"})
    runs: list[dict] = [{}, {}]
    for k, timings in enumerate(runs):
        for name in names:
            if k and name in ONCE:
                continue
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "all_queries_first_run_total",
        "value": round(sum(runs[0].values()), 3),
        "unit": "sec",
        "queries": runs[0],
        "second_run": runs[1],
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
