"""Dashboard panels that show one relation at one scrape; panels over time are in ``history``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, age_seconds, older_than, percent, pretty_bytes, two_decimals, n_rows
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.plans.resources import cache_hit_by_table, dead_percent
from fleetstat.sources.snapshots import Snapshots

# Fixed value: the query text a failed login is looked up by.
FAILED_LOGIN = "<authentication failed>"


@report("DG1")
def primary_flag(s: Snapshots) -> DataFrame:
    return s.servers.select(*SNAP, F.when(F.col("in_recovery"), 0).otherwise(1).alias("status"))


@report("DG2")
def connection_count(s: Snapshots) -> DataFrame:
    return s.activity.groupBy(*SNAP).agg(n_rows().alias("connections"))


@report("DG3")
def database_size(s: Snapshots) -> DataFrame:
    return s.database_stats.select(*SNAP, "datname", "size_bytes")


@report("DG4")
def database_hit_percent(s: Snapshots) -> DataFrame:
    hit, read = F.sum("blks_hit"), F.sum("blks_read")
    return s.database_stats.groupBy(*SNAP, "datname").agg(percent(hit, hit + read).alias("cache_hit_ratio"))


@report("DG8")
def lock_mode_counts(s: Snapshots) -> DataFrame:
    return s.locks.groupBy(*SNAP, "mode").agg(n_rows().alias("locks"))


@report("DG9", order="processes desc")
def top_wait_events(s: Snapshots, k: int = 10) -> DataFrame:
    waits = s.activity.where(F.col("wait_event").isNotNull()).groupBy(*SNAP, "wait_event_type", "wait_event").agg(n_rows().alias("processes"))
    return top_k(waits, k, F.col("processes").desc(), F.col("wait_event_type").asc(), F.col("wait_event").asc())


@report("DG10", order="mean_time_ms desc")
def slow_queries_panel(s: Snapshots, k: int = 10) -> DataFrame:
    return top_k(s.statements, k, F.col("mean_exec_time").desc_nulls_first(), F.col("queryid").asc()).select(
        *SNAP, "queryid", "calls", two_decimals("total_exec_time").alias("total_time_ms"),
        two_decimals("mean_exec_time").alias("mean_time_ms"), F.left("query", F.lit(100)).alias("query_snippet"))


@report("DG12", order="heap_blks_read desc")
def table_io_panel(s: Snapshots, k: int = 15) -> DataFrame:
    return cache_hit_by_table(s, k, by_volume=True)


@report("DG13", order="rolname")
def superusers(s: Snapshots) -> DataFrame:
    return s.roles.where("rolsuper").select(*SNAP, "rolname", "rolsuper", "rolcreaterole", "rolcreatedb", "rolcanlogin")


@report("DG14")
def failed_logins(s: Snapshots) -> DataFrame:
    failed = (F.col("state") == "idle") & (F.col("query") == FAILED_LOGIN)
    return s.activity.groupBy(*SNAP).agg(F.count_if(failed).alias("failed_logins"))


@report("DG15", order="datname")
def database_acls(s: Snapshots) -> DataFrame:
    return s.database_stats.where(F.col("datacl").isNotNull()).select(*SNAP, "datname", "datacl")


@report("DG16", order="duration_seconds desc")
def long_transactions(s: Snapshots, min_seconds: int = 3600) -> DataFrame:
    return s.activity.where(older_than("xact_start", min_seconds) & (F.col("state") != "idle")).select(
        *SNAP, "pid", "usename", "application_name", "client_addr", age_seconds("xact_start").alias("duration_seconds"),
        F.left("query", F.lit(100)).alias("query_snippet"))


@report("DG17")
def connections_by_state(s: Snapshots) -> DataFrame:
    return s.activity.groupBy(*SNAP, "state").agg(n_rows().alias("connections"))


@report("DG18", order="dead_tuple_ratio desc")
def tables_needing_vacuum(s: Snapshots, k: int = 10) -> DataFrame:
    dirty = s.table_stats.where(F.expr("n_dead_tup > 0.1 * n_live_tup")).withColumn("dead_tuple_ratio", dead_percent())
    return top_k(dirty, k, F.col("dead_tuple_ratio").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", "n_dead_tup", "n_live_tup", "dead_tuple_ratio", "last_autovacuum")


@report("DG18B", order="n_dead_tup desc")
def bloated_tables(s: Snapshots, min_dead: int = 10_000, k: int = 15) -> DataFrame:
    return top_k(s.table_stats.where(F.col("n_dead_tup") > min_dead), k, F.col("n_dead_tup").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", pretty_bytes("total_relation_size").alias("size"), "n_dead_tup", "last_vacuum", "last_autovacuum")
