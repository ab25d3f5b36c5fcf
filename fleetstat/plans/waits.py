"""Wait events, sessions and locks over ``activity`` and ``locks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, Ladder, age_seconds, older_than, snippet, two_decimals, n_rows
from fleetstat.operators.joins import blocking_pairs
from fleetstat.operators.ranking import count_share, top_k
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

# What a wait event or a session state means.
IO_EVENT = Ladder.lookup("wait_event", {
    "DataFileRead": "Reading data files from disk",
    "DataFileWrite": "Writing data files to disk",
    "WALWrite": "Writing WAL to disk",
    "WALSync": "Syncing WAL to disk",
    "CheckpointSync": "Syncing files during checkpoint",
    "CheckpointWrite": "Writing files during checkpoint",
    "BufferIO": "Buffer I/O operations",
}, "Other I/O operation")
STATE = Ladder.lookup("state", {
    "active": "Currently executing",
    "idle": "Waiting for new command",
    "idle in transaction": "In transaction, waiting for command",
    "idle in transaction (aborted)": "In failed transaction",
    "fastpath function call": "Executing fastpath function",
    "disabled": "Disabled connection",
}, "Other state")
WAL_EVENTS = {
    "CheckpointStart": "Waiting for checkpoint to start",
    "CheckpointWrite": "Writing checkpoint data",
    "CheckpointSync": "Syncing checkpoint files",
    "WALWrite": "Writing WAL records",
    "WALSync": "Syncing WAL to disk",
    "WALArchiveCommand": "WAL archive command execution",
}
WAL_EVENT = Ladder.lookup("wait_event", WAL_EVENTS, None)

# Advice per wait. None stands for a text built from the event name.
WAIT_ISSUE = Ladder.lookup("wait_event_type", {
    "IO": "I/O Performance Issue Detected",
    "Lock": "Locking Contention Detected",
    "LWLock": "Lightweight Lock Contention",
}, None)
WAIT_SUGGESTION = Ladder.lookup("wait_event", {
    "DataFileRead": "Consider: faster storage, more RAM, query optimization",
    "WALWrite": "Consider: separate WAL disk, increase wal_buffers",
    "relation": "Consider: shorter transactions, query optimization",
    "tuple": "Consider: shorter transactions, query optimization",
    "BufferPin": "Consider: increase shared_buffers",
}, None)
ADVICE_HEADER = "TUNING SUGGESTIONS BASED ON CURRENT WAITS:"

def waiting() -> Column:
    return F.col("wait_event").isNotNull()




def exclude_self(activity: DataFrame) -> DataFrame:
    """Drop the collector's own session."""
    return activity.where(~F.coalesce("is_collector", F.lit(False)))


@report("WE1", order="waiting_processes desc")
def wait_summary(s: Snapshots) -> DataFrame:
    active = s.activity.where(waiting() & (F.col("state") == "active"))
    return count_share(active, ["wait_event_type", "wait_event"], "waiting_processes", "percentage")


@report("WE2", order="blocked_duration_seconds desc")
def lock_waits(s: Snapshots, require_granted: bool = False) -> DataFrame:
    pairs = blocking_pairs(s.locks, s.activity, require_granted=require_granted)
    return pairs.select(
        *[F.col(f"l.{c}") for c in SNAP],
        F.col("l.pid").alias("blocked_pid"), F.col("l.usename").alias("blocked_user"),
        F.col("r.pid").alias("blocking_pid"), F.col("r.usename").alias("blocking_user"),
        F.col("l.query").alias("blocked_statement"), F.col("r.query").alias("current_statement_in_blocking_process"),
        F.col("l.wait_event").alias("wait_event"), F.col("l.wait_event_type").alias("wait_event_type"),
        age_seconds("l.query_start", "l.snap_ts").alias("blocked_duration_seconds"),
    )


@report("WE3", order="processes desc")
def io_waits(s: Snapshots) -> DataFrame:
    io = s.activity.where((F.col("wait_event_type") == "IO") & waiting())
    return io.groupBy(*SNAP, "wait_event_type", "wait_event").agg(n_rows().alias("processes")).withColumn(
        "description", IO_EVENT.column())


@report("WE4", order="processes desc")
def state_breakdown(s: Snapshots) -> DataFrame:
    return count_share(s.activity, ["state"], "processes", "percentage").withColumn("description", STATE.column())


@report("WE5", order="duration_seconds desc, pid")
def long_running_active(s: Snapshots, min_seconds: int = 30, k: int = 20) -> DataFrame:
    running = s.activity.where((F.col("state") == "active") & older_than("query_start", min_seconds))
    aged = running.withColumn("duration_seconds", age_seconds("query_start"))
    return top_k(aged, k, F.col("duration_seconds").desc_nulls_first(), F.col("pid").asc()).select(
        *SNAP, "pid", "usename", "application_name", "client_addr", "wait_event_type", "wait_event", "state",
        "duration_seconds", age_seconds("state_change").alias("state_duration_seconds"),
        snippet("query", 100).alias("query_snippet"),
    )


@report("WE6", order="mean_exec_time desc, queryid")
def slow_statements(s: Snapshots, min_mean_ms: float = 1000, k: int = 10) -> DataFrame:
    slow = s.statements.where(F.col("mean_exec_time") > min_mean_ms)
    return top_k(slow, k, F.col("mean_exec_time").desc_nulls_first(), F.col("queryid").asc()).select(
        *SNAP, "queryid", "calls", "total_exec_time", two_decimals("mean_exec_time").alias("mean_exec_time"),
        two_decimals("stddev_exec_time").alias("stddev_exec_time"), "rows",
        snippet("query", 80).alias("query_snippet"),
    )


@report("WE7", order="total_connections desc")
def pool_by_application(s: Snapshots) -> DataFrame:
    return s.activity.where(F.col("application_name").isNotNull()).groupBy(*SNAP, "application_name").agg(
        n_rows().alias("total_connections"),
        F.count_if(F.col("state") == "active").alias("active_connections"),
        F.count_if(F.col("state") == "idle").alias("idle_connections"),
        F.count_if(F.col("state") == "idle in transaction").alias("idle_in_transaction"),
        F.count_if(waiting()).alias("waiting_connections"),
        F.round(F.avg(age_seconds("query_start"))).alias("avg_query_duration_seconds"),
    )


@report("WE8", order="processes desc")
def wal_checkpoint_waits(s: Snapshots) -> DataFrame:
    writes = s.activity.where(F.col("wait_event").isin(*WAL_EVENTS))
    return writes.groupBy(*SNAP, "wait_event").agg(n_rows().alias("processes")).withColumn(
        "description", F.coalesce(WAL_EVENT.column(), "wait_event"))


@report("WE9", order="processes desc")
def background_workers(s: Snapshots) -> DataFrame:
    return s.activity.where(F.col("backend_type") != "client backend").groupBy(*SNAP, "backend_type").agg(
        n_rows().alias("processes"),
        F.count_if(waiting()).alias("waiting_processes"),
        # Distinct event names: a short list whatever the number of sessions.
        F.array_join(F.sort_array(F.collect_set("wait_event")), ", ").alias("wait_events"),
    )


@report("WE10")
def wait_advice(s: Snapshots, min_processes: int = 1) -> DataFrame:
    """A heading per snapshot, then one line per kind of wait seen more than ``min_processes`` times."""
    waits = s.activity.where(waiting() & (F.col("state") == "active")).groupBy(
        *SNAP, "wait_event_type", "wait_event").agg(n_rows().alias("processes"))
    lines = waits.where(F.col("processes") > min_processes).select(
        *SNAP,
        F.coalesce(WAIT_ISSUE.column(), F.concat("wait_event_type", F.lit(" Wait Detected"))).alias("analysis"),
        F.coalesce(
            WAIT_SUGGESTION.column(), F.concat(F.lit("Review PostgreSQL configuration for "), "wait_event")
        ).alias("suggestion"),
        "processes",
    )
    heading = s.activity.groupBy(*SNAP).agg(
        F.lit(ADVICE_HEADER).alias("analysis"), F.lit("").alias("suggestion"), F.lit(None).cast("bigint").alias("processes"))
    return heading.unionByName(lines)


@report("LK1", order="granted, query_start")
def locks_detail(s: Snapshots, database: int | None = None) -> DataFrame:
    """Locks, of one database and of none if one is named, with their sessions where they still exist."""
    here = s.locks if database is None else s.locks.where((F.col("database") == database) | F.col("database").isNull())
    session = s.activity.select(
        *SNAP, "pid", "usename", "application_name", "client_addr", "query_start", "state", "query")
    return here.join(session, [*SNAP, "pid"], "left").select(
        *SNAP, "locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "mode", "granted",
        "pid", "usename", "application_name", "client_addr", age_seconds("query_start").alias("query_age_seconds"),
        "query_start", "state", "query",
    )


@report("LK2", order="blocked_query_start")
def blocking_detail(s: Snapshots, require_granted: bool = False) -> DataFrame:
    pairs = blocking_pairs(s.locks, s.activity, require_granted=require_granted)
    return pairs.select(
        *[F.col(f"l.{c}") for c in SNAP],
        F.col("l.pid").alias("blocked_pid"), F.col("l.usename").alias("blocked_user"),
        F.col("l.application_name").alias("blocked_application"), F.col("l.mode").alias("blocked_mode"),
        F.col("l.query").alias("blocked_query"), F.col("l.query_start").alias("blocked_query_start"),
        age_seconds("l.query_start", "l.snap_ts").alias("blocked_seconds"),
        F.col("r.pid").alias("blocking_pid"), F.col("r.usename").alias("blocking_user"),
        F.col("r.application_name").alias("blocking_application"), F.col("r.mode").alias("blocking_mode"),
        F.col("r.query").alias("blocking_query"),
        age_seconds("r.query_start", "r.snap_ts").alias("blocking_seconds"),
    )


def _short_pairs(s: Snapshots, keys: int) -> DataFrame:
    return blocking_pairs(s.locks, s.activity, keys=keys).select(
        *[F.col(f"l.{c}") for c in SNAP],
        F.col("l.pid").alias("blocked_pid"), F.col("l.query").alias("blocked_query"),
        F.col("r.pid").alias("blocking_pid"), F.col("r.query").alias("blocking_query"),
    )


@report("J1B")
def blocking_by_tuple(s: Snapshots) -> DataFrame:
    """Pairs agreeing on lock type, database, relation, page and tuple."""
    return _short_pairs(s, 5)


@report("J1C")
def blocking_by_relation(s: Snapshots) -> DataFrame:
    """Pairs agreeing on lock type, database and relation."""
    return _short_pairs(s, 3)


@report("J3")
def relation_locks(s: Snapshots) -> DataFrame:
    held = s.locks.where(F.col("relation").isNotNull()).select(*SNAP, "pid", "mode", "granted", "relation")
    return held.join(s.activity.select(*SNAP, "pid", "query"), [*SNAP, "pid"])


@report("LK3", order="duration_seconds desc")
def locks_held_long(s: Snapshots, min_seconds: int = 300) -> DataFrame:
    old = s.activity.where(older_than("query_start", min_seconds)).select(*SNAP, "pid", "query_start", "query")
    return s.locks.where("granted").select(*SNAP, "pid", "mode", "relation", "granted").join(old, [*SNAP, "pid"]).select(
        *SNAP, "pid", "mode", "relation", "granted", age_seconds("query_start").alias("duration_seconds"), "query")
