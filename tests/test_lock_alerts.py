"""Alerts on locks take an object to be all ten columns that name it, as the blocking pairs do."""

import datetime as dt

import pytest

from fleetstat.plans import checks
from fleetstat.sources.snapshots import Snapshots

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def snaps(spark):
    # Two waiters on each of two pages of one relation, and one waiter on a third page whose holder has another page.
    locks = [(1, T0, pid, "relation", 1, 35, page, False) for pid, page in ((10, 0), (11, 0), (12, 1), (13, 1), (14, 2))]
    locks += [(1, T0, 20, "relation", 1, 35, 3, True), (1, T0, 30, "transactionid", None, None, None, False), (1, T0, 31, "transactionid", None, None, None, False)]
    none = {name: spark.createDataFrame([], "server_id long") for name in ("settings", "servers", "repl_stats")}
    return Snapshots.from_frames(
        spark, **none,
        locks=spark.createDataFrame(locks, "server_id long, snap_ts timestamp, pid long, locktype string, database long, relation long, page long, granted boolean"),
        activity=spark.createDataFrame(
            [(1, T0, pid, T0 - dt.timedelta(hours=1)) for pid in (10, 11, 12, 13, 14, 20, 30, 31)], "server_id long, snap_ts timestamp, pid long, query_start timestamp"))


def test_queues_of_different_objects_have_different_names(snaps):
    found = sorted((r["object"], r["value"]) for r in checks.alert_samples(snaps, {"waiters_on_object"}).collect())
    assert found == [("relation/1/35/page=0", 2.0), ("relation/1/35/page=1", 2.0), ("relation/1/35/page=2", 1.0), ("transactionid", 2.0)]


def test_a_lock_on_another_page_blocks_nobody(snaps):
    blocked = {r["object"] for r in checks.alert_samples(snaps, {"blocked_seconds"}).collect()}
    assert blocked == {"10", "11", "12", "13", "30", "31"}
