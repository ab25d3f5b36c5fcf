"""Replication, write-ahead log and backup readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, Ladder, age_seconds, lsn_diff, lsn_to_bytes, pretty_bytes, qualified, wal_file_name,
)
from fleetstat.operators.joins import pivot_settings, shuffled
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

GB, MB = 1024**3, 1024**2

# Thresholds and labels of the backup reports.
BACKUP_COMPLEXITY = Ladder(
    (f"size_bytes > {GB}", "Large (>1GB) - Consider parallel backup"),
    (f"size_bytes > {100 * MB}", "Medium (>100MB) - Standard backup OK"),
    default="Small (<100MB) - Fast backup expected",
)
WRAPAROUND_RISK = Ladder(
    ("xid_age > 1000000000", "CRITICAL: Backup needed before wraparound"),
    ("xid_age > 500000000", "WARNING: Consider backup frequency increase"),
    default="OK",
)
ARCHIVE_MODE = Ladder(("archive_mode = 'on'", "Enabled"), default="DISABLED - Physical backup recovery limited")
ARCHIVE_COMMAND = Ladder(
    ("archive_command = ''", "WARNING: No archive command configured"),
    ("archive_command LIKE '%/bin/true%'", "WARNING: Archive command disabled"),
    default="Configured",
)
WAL_LEVEL = Ladder(
    ("wal_level IN ('replica', 'logical')", "Suitable for backup"), default="WARNING: WAL level may be insufficient for PITR")
ARCHIVING = Ladder(
    ("last_archived_time < snap_ts - INTERVAL '1' HOUR", "WARNING: No recent archiving activity"),
    ("last_archived_time < snap_ts - INTERVAL '15' MINUTE", "NOTICE: Archive lag detected"),
    default="OK: Recent archiving activity",
)
ARCHIVE_FAILURES = Ladder(
    ("failed_count > 0 AND last_failed_time > snap_ts - INTERVAL '1' DAY", "ERROR: Recent archive failures"),
    ("failed_count > 0", "WARNING: Historical archive failures"),
    default="OK: No recent failures",
)
WAL_CONTEXT = Ladder(
    ("uptime_seconds < 3600", "Recent startup - WAL position may not indicate backup age"), default="Normal operation")
SLOT_HEALTH = Ladder(
    ("NOT active", "WARNING: Inactive slot retaining WAL"),
    (f"lag_bytes > {10 * GB}", "CRITICAL: Slot lagging >10GB - may affect backup retention"),
    (f"lag_bytes > {GB}", "WARNING: Slot lagging >1GB"),
    default="OK",
)
BACKUP_SETTINGS = (
    "max_wal_size", "wal_keep_size", "archive_timeout", "checkpoint_timeout", "checkpoint_completion_target", "wal_compression")
BACKUP_RELEVANCE = Ladder(
    ("name = 'max_wal_size' AND num < 1024", "Consider increasing for better backup performance"),
    ("name = 'max_wal_size'", "Adequate for most backups"),
    ("name = 'wal_keep_size' AND setting = '0'", "Default - relies on replication slots"),
    ("name = 'wal_keep_size' AND num < 1024", "Consider increasing for backup safety"),
    ("name = 'wal_keep_size'", "Should provide backup safety buffer"),
    ("name = 'archive_timeout' AND setting = '0'", "No forced archiving - may delay backup completeness"),
    ("name = 'archive_timeout' AND num > 3600", "Long timeout - may delay backup freshness"),
    ("name = 'archive_timeout'", "Reasonable for backup timeliness"),
    ("name = 'checkpoint_timeout' AND num > 1800", "Long interval - may affect backup consistency"),
    ("name = 'checkpoint_timeout'", "Adequate for backup needs"),
    default="Review documentation for backup implications",
)
BACKUP_CONSIDERATIONS = Ladder(
    (f"total_relation_size > {10 * GB}", "Large table - consider parallel backup or pg_dump with jobs"),
    ("n_dead_tup > 0.2 * n_live_tup", "High bloat - VACUUM before backup for efficiency"),
    ("last_vacuum IS NULL", "Never vacuumed - may have consistency issues"),
    default="Standard backup expected",
)
NO_COMMAND = "archive_command IN ('', '/bin/true', 'exit 0')"
READINESS = Ladder(
    ("archive_mode = 'off'", "CRITICAL: Archive mode disabled - PITR not possible"),
    (NO_COMMAND, "CRITICAL: Archive command not configured"),
    ("failed_count > 0 AND last_failed_time > snap_ts - INTERVAL '1' DAY", "ERROR: Recent archive failures detected"),
    ("lagging_slots > 0", "WARNING: Inactive replication slots may affect WAL retention"),
    ("max_xid_age > 1000000000", "WARNING: Transaction wraparound risk - backup urgently needed"),
    default="OK: Basic backup prerequisites met",
)
READINESS_ADVICE = Ladder(
    ("archive_mode = 'off'", "Enable archive_mode and configure archive_command for PITR"),
    (NO_COMMAND, "Configure proper archive_command for WAL archiving"),
    ("failed_count > 0", "Investigate and resolve WAL archiving failures"),
    default="Consider regular backup testing and validation procedures",
)
DUMP = "pg_dump -h localhost -p 5432 -U username "
FORMAT_RATIONALE = Ladder(
    (f"size_bytes > {10 * GB}", "Directory format with parallel jobs for large database"),
    (f"size_bytes > {GB}", "Custom format for efficient compression and selective restore"),
    default="Plain SQL format for simple restore",
)


def slots_with_lag(s: Snapshots) -> DataFrame:
    now = s.servers.select(*SNAP, "current_lsn")
    return s.repl_slots.join(now, SNAP).withColumn("lag_bytes", lsn_diff("current_lsn", "restart_lsn")).withColumn(
        "flush_bytes", lsn_diff("current_lsn", "confirmed_flush_lsn"))


@report("RP1", order="active desc, slot_name")
def slot_lag(s: Snapshots) -> DataFrame:
    return slots_with_lag(s).select(
        *SNAP, "slot_name", "slot_type", "plugin", "database", "active", "restart_lsn", "confirmed_flush_lsn",
        F.col("lag_bytes").alias("replication_lag"), pretty_bytes("lag_bytes").alias("replication_lag_bytes"),
        F.col("flush_bytes").alias("flush_lag"), pretty_bytes("flush_bytes").alias("flush_lag_bytes"))


@report("RP2", order="application_name")
def standby_lag(s: Snapshots) -> DataFrame:
    now = s.servers.select(*SNAP, "current_lsn")
    lags = {"sending_lag": "sent_lsn", "write_lag_bytes": "write_lsn", "flush_lag_bytes": "flush_lsn", "replay_lag_bytes": "replay_lsn"}
    return s.repl_stats.join(now, SNAP).select(
        *SNAP, "pid", "application_name", "client_addr", "state", "sync_state",
        *[lsn_diff("current_lsn", c).alias(name) for name, c in lags.items()],
        F.col("write_lag_s").alias("write_lag_time"), F.col("flush_lag_s").alias("flush_lag_time"),
        F.col("replay_lag_s").alias("replay_lag_time"))


@report("RP3")
def replay_delay(s: Snapshots) -> DataFrame:
    return s.servers.where("in_recovery").select(*SNAP, age_seconds("last_replay_ts").alias("replication_lag_seconds"))


@report("WL1")
def wal_position(s: Snapshots) -> DataFrame:
    return s.servers.select(
        *SNAP, wal_file_name("current_lsn").alias("current_wal_file"), F.col("current_lsn").alias("current_wal_lsn"),
        lsn_to_bytes("current_lsn").alias("wal_bytes_written"))


@report("WL2")
def archiver_status(s: Snapshots) -> DataFrame:
    return s.archiver.select(
        *SNAP, F.col("last_archived_wal").alias("last_archived_file"), "last_archived_time",
        F.col("last_failed_wal").alias("last_failed_file"), "last_failed_time", "stats_reset")


@report("WL3")
def wal_since_checkpoint(s: Snapshots) -> DataFrame:
    generated = lsn_diff("checkpoint_lsn", "redo_lsn")
    return s.servers.select(
        *SNAP, "checkpoint_lsn", "redo_lsn", generated.alias("wal_bytes"), pretty_bytes(generated).alias("wal_generated"))


@report("BK1", order="size_bytes desc")
def backup_complexity(s: Snapshots) -> DataFrame:
    return s.database_stats.where(~F.col("datname").isin("template0", "template1")).select(
        *SNAP, F.col("datname").alias("database_name"), "size_bytes", pretty_bytes("size_bytes").alias("current_size"),
        BACKUP_COMPLEXITY.column().alias("backup_complexity"), "xid_age", WRAPAROUND_RISK.column().alias("wraparound_risk"))


@report("BK2")
def archive_config(s: Snapshots) -> DataFrame:
    return pivot_settings(s.settings, "archive_mode", "archive_command", "wal_level").select(
        *SNAP, ARCHIVE_MODE.column().alias("archive_mode_status"), "archive_command",
        ARCHIVE_COMMAND.column().alias("archive_command_status"), "wal_level", WAL_LEVEL.column().alias("wal_level_status"))


@report("BK3")
def archiver_health(s: Snapshots) -> DataFrame:
    return s.archiver.select(
        *SNAP, F.col("archived_count").alias("total_archived"), F.col("last_archived_wal").alias("last_archived_file"),
        "last_archived_time", ARCHIVING.column().alias("archiving_health"), F.col("failed_count").alias("total_failed"),
        F.col("last_failed_wal").alias("last_failed_file"), "last_failed_time", ARCHIVE_FAILURES.column().alias("failure_status"))


@report("BK4")
def wal_position_context(s: Snapshots) -> DataFrame:
    return s.servers.withColumn("uptime_seconds", age_seconds("started_at")).select(
        *SNAP, F.col("current_lsn").alias("current_wal_lsn"), wal_file_name("current_lsn").alias("current_wal_file"),
        pretty_bytes(lsn_to_bytes("current_lsn")).alias("total_wal_generated"), WAL_CONTEXT.column().alias("wal_position_context"))


@report("BK5", order="lag_bytes desc nulls last")
def slot_health(s: Snapshots) -> DataFrame:
    return slots_with_lag(s).select(
        *SNAP, "slot_name", "slot_type", "database", "active", "restart_lsn", "lag_bytes",
        pretty_bytes("lag_bytes").alias("wal_lag_size"), SLOT_HEALTH.column().alias("slot_health"))


@report("BK6", order="parameter")
def backup_settings(s: Snapshots) -> DataFrame:
    return s.settings.where(F.col("name").isin(*BACKUP_SETTINGS)).withColumn("num", F.col("setting").try_cast("double")).select(
        *SNAP, F.col("name").alias("parameter"), F.col("setting").alias("current_value"), "unit",
        BACKUP_RELEVANCE.column().alias("backup_relevance"))


@report("BK7", order="total_bytes desc")
def backup_challenging_tables(s: Snapshots, min_mb: int = 100, k: int = 20) -> DataFrame:
    big = s.table_stats.where(F.col("total_relation_size") > min_mb * MB)
    return top_k(big, k, F.col("total_relation_size").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), F.col("total_relation_size").alias("total_bytes"),
        pretty_bytes("total_relation_size").alias("total_size"), pretty_bytes("relation_size").alias("table_size"),
        pretty_bytes(F.col("total_relation_size") - F.col("relation_size")).alias("indexes_toast_size"),
        F.col("n_dead_tup").alias("dead_tuples"), BACKUP_CONSIDERATIONS.column().alias("backup_considerations"),
        "last_vacuum", "last_analyze")


@report("BK8")
def backup_readiness(s: Snapshots) -> DataFrame:
    lagging = slots_with_lag(s).groupBy(*SNAP).agg(F.count_if(~F.col("active") & (F.col("lag_bytes") > GB)).alias("lagging_slots"))
    oldest = s.database_stats.groupBy(*SNAP).agg(F.max("xid_age").alias("max_xid_age"))
    facts = (
        pivot_settings(s.settings, "archive_mode", "archive_command")
        .join(shuffled(s.archiver.select(*SNAP, "failed_count", "last_failed_time")), SNAP, "left")
        .join(lagging, SNAP, "left").join(oldest, SNAP, "left"))
    return facts.select(
        *SNAP, READINESS.column().alias("overall_status"), READINESS_ADVICE.column().alias("primary_recommendation"))


@report("BK9", order="size_bytes desc")
def backup_commands(s: Snapshots) -> DataFrame:
    name = F.concat_ws("_", F.lit("backup"), "datname", F.date_format("snap_ts", "yyyy-MM-dd"))
    size = F.col("size_bytes")
    command = F.when(size > 10 * GB, F.concat(F.lit(DUMP + "-Fd -j 4 -f "), name, F.lit(" "), "datname")).when(
        size > GB, F.concat(F.lit(DUMP + "-Fc -f "), name, F.lit(".dump "), "datname")).otherwise(
        F.concat(F.lit(DUMP + "-f "), name, F.lit(".sql "), "datname"))
    return s.database_stats.where(~F.col("datname").isin("template0", "template1", "postgres")).select(
        *SNAP, F.col("datname").alias("database_name"), "size_bytes", command.alias("suggested_backup_command"),
        FORMAT_RATIONALE.column().alias("format_rationale"))
