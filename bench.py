"""Run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Seconds are wall time from building the plan to the last row written to a no-op sink, median of
the runs after one warm-up round over all queries (BENCH_RUNS, default 3; BENCH_BUDGET seconds cut
further rounds short).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatweave.plans.queries import REGISTRY  # noqa: E402
from chatweave.plans.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "300"))
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = local_session(cpus, "bench")
    names = [n for n in REGISTRY if not only or n in only]
    times: dict[str, list[float]] = {n: [] for n in names}
    started = time.perf_counter()
    for i in range(rounds + 1):
        if i > 1 and time.perf_counter() - started > budget:
            break
        for name in names:
            t = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times[name].append(time.perf_counter() - t)
            print(f"{i} {name} {time.perf_counter() - t:.2f}", file=sys.stderr, flush=True)
    queries = {n: round(statistics.median(v), 3) for n, v in times.items()}
    print(
        json.dumps(
            {
                "metric": "sum of median warm query seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "rounds": min(len(v) for v in times.values()),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
