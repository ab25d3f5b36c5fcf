"""Time the headline reports; prints one JSON line.

Relations are derived from the test tables once and stored as Parquet, as a
collector would store them; reports are then timed on the stored snapshots.
Each figure is the median of three runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = ("QP2", "QP11", "WE1", "LK2", "MI2", "PM2", "SC7", "PA5", "HU3", "ST2")
RELATIONS = (
    "statements", "activity", "locks", "table_constraints", "key_columns", "constraint_columns", "index_stats", "table_stats",
    "partition_nodes", "column_stats", "roles", "auth_members", "grants", "relations", "counters",
)


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from fleetstat.plans import registry
    from fleetstat.session import local_session
    from fleetstat.sources.snapshots import Snapshots

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fleetstat-bench")

    store = tempfile.mkdtemp(prefix="fleetstat-bench-")
    derived = Snapshots.from_tables(spark, sf_dir)
    start = time.perf_counter()
    for relation in RELATIONS:
        getattr(derived, relation).write.parquet(f"{store}/{relation}")
    prepared = time.perf_counter() - start

    stored = Snapshots.from_path(spark, store)
    seconds = {}
    for id in HEADLINE:
        build = lambda: registry.run(id, stored)  # noqa: B023, E731
        timed(build)
        seconds[registry.REPORTS[id].key] = round(statistics.median(timed(build) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_reports_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "prepare_sec": round(prepared, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
