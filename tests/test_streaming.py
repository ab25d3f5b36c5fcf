"""Streams replayed to the end equal the same function on the stored rows."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetstat.operators.alerts import evaluate_alerts
from fleetstat.plans.rules import alert_rules
from fleetstat.sources.snapshots import read_snapshot, read_snapshot_stream
from fleetstat.streaming import jobs, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    """Counter scrapes every 30 s in three files; some repeated in the next file, one file boundary late."""
    root = tempfile.mkdtemp(prefix="fleetstat-stream-")
    schema = "server_id long, snap_ts timestamp, metric_key string, value long, sample_id long, sync_state string"
    rows = []
    for k, key in enumerate(("a", "b")):
        for i in range(60):
            value = (i * (k + 2)) % 50  # wraps, so the counter resets
            rows.append((k, T0 + dt.timedelta(seconds=30 * i), key, value, i, "sync" if i % 7 < 4 else "async"))
    files = [[], [], []]
    for r in rows:
        n = r[4] // 20
        if r[4] % 20 == 19 and n < 2:
            n += 1  # delivered one file later
        files[n].append(r)
        if r[4] % 10 == 0 and n < 2:
            files[n + 1].append(r)  # delivered twice
    # A last row far ahead moves the watermark past every window.
    files.append([(9, T0 + dt.timedelta(days=2), "end", 0, 999, "sync")])
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(os.path.join(root, "counters"))
    return root, spark.createDataFrame(rows, schema)


def drain(spark, frame, name):
    out = tempfile.mkdtemp(prefix="fleetstat-out-")
    query = jobs.append_to(frame, f"{out}/{name}", f"{out}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.read.parquet(f"{out}/{name}").where("server_id <> 9")


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def stream(spark, store):
    frame = read_snapshot_stream(spark, os.path.join(store[0], "counters"), "counters", max_files=1)
    return windows.deduplicated(frame, ["server_id", "snap_ts", "metric_key"], "20 minutes")


def test_rate_with_late_and_repeated_scrapes(spark, store):
    live = drain(spark, windows.counter_rate(stream(spark, store), ["server_id", "metric_key"], lateness="20 minutes"), "rate")
    batch = windows.counter_rate(store[1], ["server_id", "metric_key"])
    assert rows(live) == rows(batch) and live.count() > 0


def test_state_changes(spark, store):
    live = drain(spark, windows.state_changes(stream(spark, store), ["server_id", "metric_key"], "sync_state", "10 minutes", "20 minutes"), "changes")
    assert rows(live) == rows(windows.state_changes(store[1], ["server_id", "metric_key"], "sync_state", "10 minutes"))


def test_activity_and_hit_ratio(spark, store):
    as_activity = lambda df: df.select("server_id", "snap_ts", F.col("sync_state").alias("state"), F.lit("autovacuum: x").alias("query"))
    live = drain(spark, windows.activity_over_time(as_activity(stream(spark, store)), "5 minutes", "20 minutes"), "activity")
    assert rows(live) == rows(windows.activity_over_time(as_activity(store[1]), "5 minutes"))
    as_io = lambda df: df.select("server_id", "snap_ts", F.col("value").alias("blks_hit"), (F.col("value") * 2).alias("blks_read"))
    live = drain(spark, windows.hit_ratio_over_time(as_io(stream(spark, store)), ["server_id"], lateness="20 minutes"), "ratio")
    assert rows(live) == rows(windows.hit_ratio_over_time(as_io(store[1]), ["server_id"]))


def test_sustained_alerts(spark, store):
    rules = spark.createDataFrame([("R", "value", 20.0, None, False, "WARNING", 120)],
                                  "rule_set string, metric string, low double, high double, inclusive boolean, severity string, for_seconds bigint")
    sample = lambda df: df.select("server_id", "snap_ts", F.lit("value").alias("metric"), F.col("metric_key").alias("object"),
                                  F.col("value").cast("double").alias("value"))
    live = drain(spark, windows.sustained_alerts(evaluate_alerts(sample(stream(spark, store)), rules), lateness="20 minutes"), "alerts")
    expected = windows.sustained_alerts(evaluate_alerts(sample(store[1]), rules))
    assert rows(live) == rows(expected) and expected.count() > 0
    assert all(r.lasted_seconds >= 120 for r in expected.collect())


def test_blocking_pairs_to_episodes(spark):
    root = tempfile.mkdtemp(prefix="fleetstat-stream-")
    for i in range(5):  # five scrapes; in the third and fourth nobody waits
        t = T0 + dt.timedelta(seconds=30 * i)
        spark.createDataFrame([(1, t, 1, "relation", 7, "ShareLock", True), (1, t, 2, "relation", 7, "ShareLock", i in (2, 3))],
                              "server_id long, snap_ts timestamp, pid long, locktype string, relation long, mode string, granted boolean"
                              ).selectExpr("*", "cast(null as bigint) database", "cast(null as bigint) transactionid", "cast(null as bigint) page",
                                           "cast(null as bigint) tuple", "cast(null as string) virtualxid", "cast(null as bigint) classid",
                                           "cast(null as bigint) objid", "cast(null as bigint) objsubid").coalesce(1).write.mode("append").parquet(f"{root}/locks")
        spark.createDataFrame([(1, t, p) for p in (1, 2)], "server_id long, snap_ts timestamp, pid long").selectExpr(
            "*", "'u' usename", "'q' query", "snap_ts query_start", "'e' wait_event", "'t' wait_event_type", "'a' application_name",
            "'active' state").write.mode("append").parquet(f"{root}/activity")
    locks = read_snapshot_stream(spark, f"{root}/locks", "locks", max_files=1)
    query = jobs.blocking_pair_writer(locks, lambda: spark.read.parquet(f"{root}/activity"), f"{root}/pairs", f"{root}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    pairs = spark.read.parquet(f"{root}/pairs")
    found = windows.blocking_episodes(pairs, gap="1 minute").orderBy("first_seen").collect()
    assert [(r.blocked_pid, r.blocking_pid, r.scrapes) for r in found] == [(2, 1, 2), (2, 1, 1)]


def test_a_scrape_split_over_batches_keeps_its_pairs_and_old_scrapes_are_not_read(spark):
    root = tempfile.mkdtemp(prefix="fleetstat-stream-")
    names = "cast(null as bigint) database, cast(null as bigint) transactionid, cast(null as bigint) page, cast(null as bigint) tuple, " \
            "cast(null as string) virtualxid, cast(null as bigint) classid, cast(null as bigint) objid, cast(null as bigint) objsubid"
    schema = "server_id long, snap_ts timestamp, pid long, locktype string, relation long, mode string, granted boolean"
    t1, t2 = T0, T0 + dt.timedelta(days=1, microseconds=7)
    # The holder of the second scrape comes one file after its waiter; the first scrape is closed by then.
    files = [[(1, t1, 1, True), (1, t1, 2, False)], [(1, t2, 4, False)], [(1, t2, 3, True)]]
    for part in files:
        spark.createDataFrame([(s, t, p, "relation", 7, "ShareLock", g) for s, t, p, g in part], schema).selectExpr("*", *names.split(", ")).coalesce(1).write.mode(
            "append").parquet(f"{root}/locks")
    spark.createDataFrame([(1, t, p) for t, p in ((t1, 1), (t1, 2), (t2, 3), (t2, 4))], "server_id long, snap_ts timestamp, pid long").selectExpr(
        "*", "'u' usename", "'q' query", "snap_ts query_start", "'e' wait_event", "'t' wait_event_type", "'a' application_name",
        "'active' state").write.parquet(f"{root}/activity")
    read = []
    locks = read_snapshot_stream(spark, f"{root}/locks", "locks", max_files=1)
    original = type(spark.read).parquet

    def noted(reader, *paths, **options):
        read.append(paths)
        return original(reader, *paths, **options)

    type(spark.read).parquet = noted
    try:
        query = jobs.blocking_pair_writer(locks, lambda: spark.read.parquet(f"{root}/activity"), f"{root}/pairs", f"{root}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    finally:
        type(spark.read).parquet = original
    pairs = {(r.snap_ts, r.blocked_pid, r.blocking_pid) for r in spark.read.parquet(f"{root}/pairs").collect()}
    assert pairs == {(t1, 2, 1), (t2, 4, 3)}
    opened = [paths for paths in read if any("_locks" in p for p in paths)]
    assert len(opened) == 3 and all(len(paths) == 1 and "/scrape=" in paths[0] for paths in opened)


def test_rules_are_few_and_read_from_one_table(spark):
    assert 0 < alert_rules(spark).count() < 100
    assert {r.rule_set for r in alert_rules(spark, "AL4").collect()} == {"AL4"}
