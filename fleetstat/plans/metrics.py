"""Metrics for exporters, and their text formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, n_rows
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.plans.resources import BGWRITER, session_counts
from fleetstat.sources import sinks
from fleetstat.sources.snapshots import Snapshots

# Counters exported per database.
DATABASE_COUNTERS = ("numbackends", "xact_commit", "xact_rollback", "blks_read", "blks_hit", "tup_returned", "tup_fetched",
                     "tup_inserted", "tup_updated", "tup_deleted")


@report("EX1")
def database_counters(s: Snapshots) -> DataFrame:
    return sinks.metric_rows(
        s.database_stats.where(F.col("datname").isNotNull()),
        {f"pg_stat_database_{c}": F.col(c) for c in DATABASE_COUNTERS}, {"datname": F.col("datname")})


@report("EX2")
def connections_metric(s: Snapshots) -> DataFrame:
    counts = s.activity.groupBy(*SNAP, F.coalesce("state", F.lit("unknown")).alias("state")).agg(n_rows().alias("n"))
    return sinks.metric_rows(counts, {"pg_stat_activity_connections": F.col("n")}, {"state": F.col("state")})


@report("EX3")
def bgwriter_metric(s: Snapshots) -> DataFrame:
    return sinks.metric_rows(s.bgwriter, {f"pg_stat_bgwriter_{c}": F.col(c) for c in BGWRITER})


@report("EX4")
def locks_metric(s: Snapshots) -> DataFrame:
    counts = s.locks.groupBy(*SNAP, "mode").agg(n_rows().alias("n"))
    return sinks.metric_rows(counts, {"pg_locks_count": F.col("n")}, {"mode": F.col("mode")})


@report("EX5")
def table_size_metric(s: Snapshots, k: int = 20) -> DataFrame:
    tables = s.table_stats.where(~F.col("schemaname").isin("information_schema", "pg_catalog"))
    biggest = top_k(tables, k, F.col("total_relation_size").desc_nulls_first(), F.col("relid").asc())
    return sinks.metric_rows(biggest, {"pg_table_size_bytes": F.col("total_relation_size")},
                             {"schema": F.col("schemaname"), "table": F.col("table_name")})


@report("EX6")
def replication_lag_metric(s: Snapshots) -> DataFrame:
    return sinks.metric_rows(s.repl_stats, {"pg_replication_lag_seconds": F.col("replay_lag_s")},
                             {"client_addr": F.col("client_addr"), "application_name": F.col("application_name")})


@report("EX7")
def statement_metrics(s: Snapshots, min_calls: int = 100, k: int = 50) -> DataFrame:
    frequent = s.statements.where(F.col("calls") > min_calls)
    heavy = top_k(frequent, k, F.col("total_exec_time").desc_nulls_first(), F.col("queryid").asc())
    return sinks.metric_rows(heavy, {
        "pg_stat_statements_calls_total": F.col("calls"),
        "pg_stat_statements_total_time_seconds": F.col("total_exec_time") / 1000,
        "pg_stat_statements_mean_time_seconds": F.round(F.col("mean_exec_time") / 1000, 6),
    }, {"queryid": F.col("queryid")})


@report("EX8")
def basic_metrics(s: Snapshots, database: str | None = None) -> DataFrame:
    """Twelve basic metrics per server, of one database or of all together."""
    databases = s.database_stats if database is None else s.database_stats.where(F.col("datname") == database)
    sums = databases.groupBy(*SNAP).agg(*[
        F.sum(c).alias(c) for c in ("size_bytes", "xact_commit", "xact_rollback", "blks_read", "blks_hit", "temp_files", "temp_bytes")])
    wide = session_counts(s.activity).join(sums, SNAP, "left")
    return sinks.metric_rows(wide, {
        "pg_up": F.lit(1), "pg_connections_total": F.col("total"), "pg_connections_active": F.col("active"),
        "pg_connections_idle": F.col("idle"), "pg_database_size_bytes": F.col("size_bytes"),
        "pg_transactions_total": F.col("xact_commit") + F.col("xact_rollback"), "pg_commits_total": F.col("xact_commit"),
        "pg_rollbacks_total": F.col("xact_rollback"), "pg_blocks_read_total": F.col("blks_read"),
        "pg_blocks_hit_total": F.col("blks_hit"), "pg_temp_files_total": F.col("temp_files"), "pg_temp_bytes_total": F.col("temp_bytes")})


@report("EX9")
def slow_query_metric(s: Snapshots, min_mean_ms: float = 1000, k: int = 10) -> DataFrame:
    slow = top_k(s.statements.where(F.col("mean_exec_time") > min_mean_ms), k,
                 F.col("mean_exec_time").desc_nulls_first(), F.col("queryid").asc())
    return sinks.metric_rows(slow, {"pg_slow_queries": F.col("calls")}, {"query_hash": F.md5("query")})


def all_metrics(s: Snapshots) -> DataFrame:
    parts = [database_counters, connections_metric, bgwriter_metric, locks_metric, table_size_metric, replication_lag_metric,
             statement_metrics, basic_metrics, slow_query_metric]
    return reduce(DataFrame.unionByName, [build(s) for build in parts])


@report("S3")
def metrics_long(s: Snapshots) -> DataFrame:
    return all_metrics(s)


@report("S4", order="server_id, metric, part, line")
def prometheus_lines(s: Snapshots) -> DataFrame:
    return sinks.to_prometheus_lines(all_metrics(s))


@report("S5")
def influx_lines(s: Snapshots) -> DataFrame:
    return sinks.to_influx_lines(all_metrics(s), s.servers)


@report("S6")
def metrics_json(s: Snapshots) -> DataFrame:
    """The document of every server, read back to show its contents in order."""
    docs = sinks.to_metrics_json(basic_metrics(s), s.servers)
    values = F.from_json(F.get_json_object("body", "$.metrics"), "map<string,double>")
    shown = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(38,0)").cast("string")))
    return docs.select(
        *SNAP, F.get_json_object("body", "$.host").alias("host"), F.get_json_object("body", "$.port").alias("port"),
        F.get_json_object("body", "$.timestamp").alias("timestamp"), F.array_join(shown, ";").alias("metrics_in_order"))


@report("S9", order="tier")
def retention_summary(s: Snapshots, keep_days: int = 30, compress_days: int = 7) -> DataFrame:
    newest = s.stored_snapshots.agg(F.max("snap_ts")).scalar()
    return sinks.retention_summary(sinks.retention_tiers(s.stored_snapshots, newest, keep_days, compress_days))
