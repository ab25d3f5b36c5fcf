"""Streams with carried state, replayed from files, equal their stored twins; alerts fire while a breach lasts."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetstat.operators import alerts, history
from fleetstat.plans.rules import SCHEMA
from fleetstat.sources.snapshots import Snapshots
from fleetstat.plans import registry
from fleetstat.streaming import jobs, stateful, windows

T0 = dt.datetime(2024, 1, 1)


def replay(spark, schema, files, build):
    """Run a stream over the files one at a time and return what it wrote; a last file moves the watermark past everything."""
    root = tempfile.mkdtemp(prefix="fleetstat-stream-")
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = jobs.append_to(build(frame), f"{root}/out", f"{root}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.read.parquet(f"{root}/out").where("server_id <> 99")


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


IO = "server_id long, snap_ts timestamp, datname string, blks_hit long, blks_read long, sample_id long, sync_state string"


@pytest.fixture(scope="module")
def io_rows():
    """Scrapes every 7 minutes with resets, NULLs, one of them late by a file, over window edges and a silent day."""
    made = []
    for server, name in ((1, "a"), (1, None), (2, "b")):
        for i in range(60):
            at = T0 + dt.timedelta(minutes=7 * i, days=2 if i > 40 else 0)
            hit = None if i == 13 else (i * 37) % 400
            made.append((server, at, name, hit, (i * 5) % 90, i, None if i % 11 == 0 else "sync" if i % 7 < 4 else "async"))
    files = [[], [], []]
    for r in made:
        n = r[5] // 20
        files[min(2, n + 1) if r[5] % 20 == 19 else n].append(r)
    files.append([(99, T0 + dt.timedelta(days=9), "end", 0, 0, 0, "sync")])
    return made, files


def stored_steps(df, keys, counters, window):
    deltas = history.counter_delta(df, keys, counters, tie="sample_id").where("prev_ts IS NOT NULL").withColumn("w", F.window("snap_ts", window))
    return deltas.groupBy("w", *keys).agg(*[F.sum(f"{c}_delta").alias(c) for c in counters]).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *counters)


def test_counter_steps_cross_window_edges(spark, io_rows):
    made, files = io_rows
    keys, counters = ["server_id", "datname"], ["blks_hit", "blks_read"]
    live = replay(spark, IO, files, lambda f: stateful.counter_steps(f, keys, counters, "1 hour", lateness="3 hours"))
    stored = stored_steps(spark.createDataFrame(made, IO), keys, counters, "1 hour")
    assert rows(live) == rows(stored) and live.count() > 20
    inside = windows.hit_ratio_over_time(spark.createDataFrame(made, IO), keys, "1 hour")
    assert live.agg(F.sum("blks_read")).first()[0] > inside.agg(F.sum("read")).first()[0]


def test_state_steps_cross_window_edges(spark, io_rows):
    made, files = io_rows
    keys = ["server_id", "datname"]
    live = replay(spark, IO, files, lambda f: stateful.state_steps(f, keys, "sync_state", "1 hour", lateness="3 hours"))
    paired = history.with_previous(spark.createDataFrame(made, IO), keys, ["snap_ts", "sample_id"], ["sync_state"]).where("prev IS NOT NULL")
    stored = paired.withColumn("w", F.window("snap_ts", "1 hour")).groupBy("w", *keys).agg(
        F.count_if(~F.col("sync_state").eqNullSafe(F.col("prev.sync_state"))).alias("changes")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "changes")
    assert rows(live) == rows(stored)


SAMPLE = "server_id long, snap_ts timestamp, metric string, object string, value double"
RULES = [("R", "standby_catchup", 0.0, None, False, "WARNING", 1800), ("R", "lag", 30.0, None, False, "MONITOR", 300)]


def catchup(minutes, value=1.0, object="s1", server=1, metric="standby_catchup"):
    return [(server, T0 + dt.timedelta(minutes=m), metric, object, value) for m in minutes]


def test_a_breach_that_never_ends_fires_after_its_time(spark):
    rules = spark.createDataFrame(RULES, SCHEMA)
    made = catchup(range(0, 200, 5))
    fired = alerts.lasting_alerts(spark.createDataFrame(made, SAMPLE), rules).orderBy("snap_ts").collect()
    assert [r["snap_ts"] for r in fired] == [T0 + dt.timedelta(minutes=m) for m in range(30, 200, 5)]
    assert {r["since"] for r in fired} == {T0}


def test_what_ends_a_breach(spark):
    rules = spark.createDataFrame(RULES, SCHEMA)
    recovered = catchup([0, 10, 20]) + catchup([25], 0.0) + catchup([29, 30, 40, 58]) + catchup([59], object="s1")
    silent = catchup([0, 20, 81, 100], object="s2")
    midnight = catchup(range(1420, 1480, 10), object=None)
    short = catchup([0, 4], 31.0, "s3", metric="lag") + catchup([0, 5], 31.0, "s4", metric="lag") + catchup([0, 5], 30.0, "s5", metric="lag")
    fired = alerts.lasting_alerts(spark.createDataFrame(recovered + silent + midnight + short, SAMPLE), rules).collect()
    got = sorted((str(r["object"]), int((r["snap_ts"] - T0).total_seconds() // 60)) for r in fired)
    assert got == [("None", 1450), ("None", 1460), ("None", 1470), ("s1", 59), ("s4", 5)]


def test_lasting_alerts_of_a_stream(spark):
    """Equal to the stored twin, and sent although the breach never ends."""
    made = catchup(range(0, 300, 7)) + catchup(range(3, 300, 11), object="s2") + catchup([80, 81, 200], 0.0, "s2")
    made += catchup(range(0, 60, 2), 50.0, "s3", 2, "lag") + catchup(range(150, 170, 2), 50.0, "s3", 2, "lag")
    made.sort(key=lambda r: r[1])
    files = [made[:40], made[42:90] + made[40:42], made[90:]]
    stored = alerts.lasting_alerts(spark.createDataFrame(made, SAMPLE), spark.createDataFrame(RULES, SCHEMA))
    files.append([(99, T0 + dt.timedelta(days=9), "standby_catchup", "end", 0.0)])
    live = replay(spark, SAMPLE, files, lambda f: stateful.lasting_alerts(f, spark.createDataFrame(RULES, SCHEMA), lateness="2 hours"))
    assert rows(live) == rows(stored) and live.where("object = 's1'").count() > 30


def test_replayed_snapshots_equal_st3(spark):
    """ST3 of the test tables, once stored and once as a stream of their rows in two halves."""
    snaps = Snapshots.from_tables(spark, "/root/testdata/sf0.001")
    stored = registry.run("ST3", snaps)
    root = tempfile.mkdtemp(prefix="fleetstat-stream-")
    ordered = snaps.io_history
    middle = ordered.agg(F.percentile_approx(F.unix_micros("snap_ts"), 0.5)).first()[0]
    for part in (ordered.where(F.unix_micros("snap_ts") <= middle), ordered.where(F.unix_micros("snap_ts") > middle)):
        part.coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    end = spark.createDataFrame([(99, dt.datetime(2100, 1, 1), "end", 0, 0, 0)], ordered.schema)
    end.coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    frame = spark.readStream.schema(ordered.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "in"))
    steps = stateful.counter_steps(frame, ["server_id", "datname"], ["blks_hit", "blks_read"], "1 day", lateness="1 hour")
    query = jobs.append_to(steps, f"{root}/out", f"{root}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    live = spark.read.parquet(f"{root}/out").where("server_id <> 99").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "server_id", "datname", F.col("blks_hit").alias("hit"), F.col("blks_read").alias("read"))
    assert rows(live) == rows(stored.select("window_start", "server_id", "datname", "hit", "read"))
