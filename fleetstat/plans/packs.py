"""Ad-hoc troubleshooting statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, n_rows, age_seconds, as_number, matches_ci, percent, pretty_bytes, qualified, whole_quotient,
)
from fleetstat.operators.joins import with_settings
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

MB = 1024**2
def statement_id() -> Column:
    return F.col("queryid").asc()




@report("TP1", order="connections desc")
def connections_per_database(s: Snapshots) -> DataFrame:
    return s.activity.groupBy(*SNAP, "datname").agg(n_rows().alias("connections"))


@report("TP2")
def connections_available(s: Snapshots) -> DataFrame:
    used = s.activity.groupBy(*SNAP).agg(n_rows().alias("used_conn"))
    return with_settings(used, s.settings, "max_connections").select(
        *SNAP, as_number("max_connections").alias("max_conn"), "used_conn",
        (as_number("max_connections") - F.col("used_conn")).alias("available"))


@report("TP3", order="runtime_seconds desc")
def long_running(s: Snapshots) -> DataFrame:
    """Sessions that are not idle; a session without a state is left out too."""
    return s.activity.where(F.col("state") != "idle").select(
        *SNAP, "pid", age_seconds("query_start").alias("runtime_seconds"), "usename", "datname", "state", "query")


@report("TP4")
def waiting_sessions(s: Snapshots) -> DataFrame:
    return s.activity.where(F.col("wait_event").isNotNull()).select(
        *SNAP, "pid", "wait_event_type", "wait_event", "state", "query")


@report("TP5", order="n_dead_tup desc")
def dead_tuples(s: Snapshots, min_dead: int = 1000) -> DataFrame:
    return s.table_stats.where(F.col("n_dead_tup") > min_dead).select(
        *SNAP, "table_name", "n_dead_tup", "n_live_tup", "last_vacuum", "last_autovacuum")


@report("TP6", order="total_bytes desc")
def largest_tables(s: Snapshots, k: int = 10) -> DataFrame:
    return top_k(s.table_stats, k, F.col("total_relation_size").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", F.col("total_relation_size").alias("total_bytes"),
        pretty_bytes("total_relation_size").alias("total_size"))


@report("TP7", order="index_bytes desc")
def largest_indexes(s: Snapshots, k: int = 10) -> DataFrame:
    return top_k(s.index_stats, k, F.col("index_size").desc_nulls_first(), F.col("index_name").asc()).select(
        *SNAP, "index_name", F.col("index_size").alias("index_bytes"), pretty_bytes("index_size").alias("index_size"),
        F.col("idx_scan").alias("scans"))


@report("TP8", order="index_bytes desc")
def zero_scan_indexes(s: Snapshots) -> DataFrame:
    return s.index_stats.where(F.col("idx_scan") == 0).select(
        *SNAP, "schemaname", "table_name", "index_name", "idx_scan", F.col("index_size").alias("index_bytes"))


@report("TP9", order="shared_blks_read desc")
def top_by_blocks_read(s: Snapshots, k: int = 10) -> DataFrame:
    return top_k(s.statements, k, F.col("shared_blks_read").desc_nulls_first(), statement_id()).select(
        *SNAP, "queryid", "query", "shared_blks_read", "local_blks_read", "temp_blks_read")


@report("TP10")
def database_hit_ratio(s: Snapshots) -> DataFrame:
    hit, read = F.sum("blks_hit"), F.sum("blks_read")
    return s.database_stats.groupBy(*SNAP).agg(
        F.try_divide(hit.cast("double"), (hit + read).cast("double")).alias("hit_ratio"))


@report("TP11", order="conn_count desc")
def connection_summary(s: Snapshots) -> DataFrame:
    return s.activity.groupBy(*SNAP, "datname", "usename", "client_addr", "state").agg(n_rows().alias("conn_count"))


@report("TP12", order="hot_update_ratio desc")
def hot_ratio(s: Snapshots) -> DataFrame:
    return s.table_stats.select(
        *SNAP, "table_name", "n_tup_upd", "n_tup_hot_upd", percent("n_tup_hot_upd", "n_tup_upd").alias("hot_update_ratio"))


@report("TP13", order="total_plan_time desc")
def top_by_plan_time(s: Snapshots, k: int = 10) -> DataFrame:
    return top_k(s.statements, k, F.col("total_plan_time").desc_nulls_first(), statement_id()).select(
        *SNAP, "queryid", "query", "calls", "total_plan_time", F.round("mean_plan_time", 4).alias("mean_plan_time"))


@report("TP14", order="hit_ratio")
def hit_ratio_int(s: Snapshots, k: int = 10) -> DataFrame:
    """Hit percentage truncated to a whole number."""
    blocks = F.col("shared_blks_hit") + F.col("shared_blks_read")
    ranked = s.statements.withColumn("hit_ratio", whole_quotient(F.col("shared_blks_hit") * 100, blocks))
    return top_k(ranked, k, F.col("hit_ratio").asc_nulls_last(), statement_id()).select(*SNAP, "queryid", "query", "calls", "hit_ratio")


@report("TP15", order="temp_blks_written desc")
def top_by_temp(s: Snapshots, k: int = 10) -> DataFrame:
    return top_k(s.statements, k, F.col("temp_blks_written").desc_nulls_first(), statement_id()).select(
        *SNAP, "queryid", "query", "temp_blks_written")


@report("TP16", order="temp_bytes desc")
def temp_by_database(s: Snapshots) -> DataFrame:
    return s.database_stats.select(*SNAP, "datname", "temp_bytes", "temp_files")


@report("TP17", order="overhead_bytes desc")
def overhead_size(s: Snapshots, k: int = 10) -> DataFrame:
    extra = s.table_stats.withColumn("overhead_bytes", F.col("total_relation_size") - F.col("relation_size"))
    return top_k(extra, k, F.col("overhead_bytes").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", pretty_bytes("total_relation_size").alias("total_size"),
        pretty_bytes("relation_size").alias("table_size"), "overhead_bytes",
        pretty_bytes("overhead_bytes").alias("index_and_toast_size"))


@report("TP18")
def never_maintained(s: Snapshots) -> DataFrame:
    return s.table_stats.where(F.col("last_vacuum").isNull() | F.col("last_analyze").isNull()).select(
        *SNAP, "schemaname", "table_name", "last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze")


@report("TP19")
def autovacuum_workers(s: Snapshots) -> DataFrame:
    running = s.activity.groupBy(*SNAP).agg(F.count_if(F.col("query").like("%autovacuum%")).alias("running_autovacuums"))
    return with_settings(running, s.settings, "autovacuum_max_workers").select(
        *SNAP, "running_autovacuums", as_number("autovacuum_max_workers").alias("max_workers"))


@report("TP20", order="n_dead_tup desc")
def missing_stats(s: Snapshots) -> DataFrame:
    return s.table_stats.where(F.col("last_analyze").isNull() | F.col("last_autoanalyze").isNull()).select(
        *SNAP, "table_name", "n_live_tup", "n_dead_tup", "last_analyze", "last_autoanalyze")


@report("TP21")
def ddl_in_flight(s: Snapshots) -> DataFrame:
    return s.activity.where(matches_ci("query", "(alter|create|drop)") & (F.col("state") != "idle")).select(
        *SNAP, "pid", "query", "wait_event_type", "wait_event")


@report("TP22", order="size_bytes desc")
def tablespace_sizes(s: Snapshots) -> DataFrame:
    return s.tablespaces.select(*SNAP, "spcname", "size_bytes", pretty_bytes("size_bytes").alias("size"), "location")


@report("TP23")
def mentions_deadlock(s: Snapshots) -> DataFrame:
    return s.activity.where(matches_ci("query", "deadlock")).select(*SNAP, "pid", "usename", "datname", "state", "query")


@report("TP24", order="index_bytes desc")
def low_use_indexes(s: Snapshots, max_scans: int = 50, min_mb: int = 0, k: int = 10) -> DataFrame:
    rare = s.index_stats.where((F.col("idx_scan") < max_scans) & (F.col("index_size") >= min_mb * MB))
    return top_k(rare, k, F.col("index_size").desc_nulls_first(), F.col("index_name").asc()).select(
        *SNAP, "index_name", F.col("index_size").alias("index_bytes"), pretty_bytes("index_size").alias("size"), "idx_scan")


@report("J15")
def vacuum_progress(s: Snapshots) -> DataFrame:
    sessions = s.activity.select(*SNAP, "pid", "wait_event_type", "wait_event", "query")
    names = s.relations.select(*SNAP, F.col("oid").alias("relid"), qualified().alias("relation_name"))
    return s.progress_vacuum.join(sessions, [*SNAP, "pid"]).join(names, [*SNAP, "relid"]).select(
        *SNAP, "pid", "relation_name", "phase", "wait_event_type", "wait_event", "query")
