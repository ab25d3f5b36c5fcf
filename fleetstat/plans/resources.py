"""Sizes, memory, connections, input/output, wraparound and bloat."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, n_rows, Ladder, as_number, percent, pretty_bytes, qualified, setting_bytes, wraparound_percent,
)
from fleetstat.operators.joins import pivot_settings, with_settings
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

GB = 1024**3

# Thresholds and labels of the resource reports.
DATABASE_SIZE = Ladder(
    (f"size_bytes > {100 * GB}", "VERY_LARGE (>100GB)"),
    (f"size_bytes > {10 * GB}", "LARGE (>10GB)"),
    (f"size_bytes > {GB}", "MEDIUM (>1GB)"),
    default="SMALL (<1GB)",
)
MEMORY_SETTINGS = {
    "shared_buffers": "Shared buffer pool size",
    "work_mem": "Memory per sort/hash operation",
    "maintenance_work_mem": "Memory for maintenance operations",
    "effective_cache_size": "Estimated OS cache size",
    "wal_buffers": "WAL buffer size",
    "max_connections": "Maximum concurrent connections",
}
MEMORY_SETTING = Ladder.lookup("name", MEMORY_SETTINGS, None)
CONNECTION_KPIS = {
    "Total Connections": "total",
    "Active Connections": "active",
    "Idle Connections": "idle",
    "Idle in Transaction": "idle_tx",
}
CACHE_PERFORMANCE = Ladder(
    ("blks_hit + blks_read = 0", "NO_ACTIVITY"),
    ("blks_hit > 0.95 * (blks_hit + blks_read)", "EXCELLENT"),
    ("blks_hit > 0.9 * (blks_hit + blks_read)", "GOOD"),
    ("blks_hit > 0.8 * (blks_hit + blks_read)", "FAIR"),
    default="POOR",
)
INDEX_USAGE = Ladder(
    ("idx_scan = 0", "UNUSED"), ("idx_scan < 10", "RARELY_USED"), ("idx_scan < 100", "MODERATELY_USED"),
    default="FREQUENTLY_USED",
)
INDEX_RECOMMENDATION = Ladder(
    ("idx_scan = 0", "Consider dropping if confirmed unused"),
    (f"idx_scan < 10 AND index_size > {10 * 1024**2}", "Large rarely used index"),
    default="Normal usage",
)
BGWRITER = {
    "checkpoints_timed": ("Checkpoints Timed", "Scheduled checkpoints"),
    "checkpoints_req": ("Checkpoints Requested", "Requested checkpoints (may indicate tuning needed)"),
    "checkpoint_write_time": ("Checkpoint Write Time (ms)", "Time spent writing files during checkpoint"),
    "checkpoint_sync_time": ("Checkpoint Sync Time (ms)", "Time spent syncing files during checkpoint"),
    "buffers_checkpoint": ("Buffers Checkpoint", "Buffers written during checkpoints"),
    "buffers_clean": ("Buffers Clean", "Buffers written by background writer"),
    "buffers_backend": ("Buffers Backend", "Buffers written directly by backends"),
}
WAL_KV = [
    ("WAL Location", "Current WAL write location"),
    ("WAL Buffers", "Configured WAL buffer size"),
    ("Checkpoint Segments", "WAL segments between checkpoints (if applicable)"),
    ("Max WAL Size", "Maximum size to let WAL grow during automatic checkpoints"),
]
MAINTENANCE_STATUS = Ladder(
    ("n_dead_tup > 0.2 * n_live_tup", "VACUUM_NEEDED"),
    ("n_dead_tup > 0.1 * n_live_tup", "VACUUM_SOON"),
    ("last_analyze < snap_ts - INTERVAL '7' DAY AND n_tup_ins + n_tup_upd + n_tup_del > 1000", "ANALYZE_NEEDED"),
    default="OK",
)
CONNECTION_ADVICE = Ladder(
    ("current_connections > 0.8 * max_connections",
     "HIGH CONNECTION USAGE: Consider connection pooling or increasing max_connections"),
    ("current_connections > 0.6 * max_connections", "MODERATE CONNECTION USAGE: Monitor connection patterns"),
    default="CONNECTION USAGE: Normal",
)
CACHE_ADVICE = Ladder(
    ("hits < 0.9 * (hits + disk_reads)", "LOW CACHE HIT RATIO (<90%): Consider increasing shared_buffers"),
    ("hits < 0.95 * (hits + disk_reads)", "MODERATE CACHE HIT RATIO (<95%): Monitor I/O patterns"),
    default="CACHE HIT RATIO: Excellent (>95%)",
)
CHECKPOINT_ADVICE = Ladder(
    ("checkpoints_req > 0.1 * checkpoints_timed",
     "FREQUENT CHECKPOINT REQUESTS: Consider increasing max_wal_size or checkpoint_completion_target"),
    ("checkpoints_req > 0", "OCCASIONAL CHECKPOINT REQUESTS: Monitor WAL generation"),
    default="CHECKPOINT BEHAVIOR: Normal",
)
BLOAT_BAND = Ladder(
    ("dead_tuple_percent > 60", "emergency"),
    ("dead_tuple_percent > 40", "critical"),
    ("dead_tuple_percent > 20", "warning"),
    ("dead_tuple_percent > 10", "monitor"),
    ("dead_tuple_percent >= 0", "healthy"),
    default=None,
)
FREEZE_MARGIN = 50_000_000
WRAPAROUND_WARNING = 2**31 - 40_000_000


def dead_percent() -> Column:
    return percent("n_dead_tup", F.col("n_live_tup") + F.col("n_dead_tup"))


def sentence(rules: tuple) -> Column:
    """The first sentence whose condition holds, columns filled in."""
    chosen = F
    for condition, text in rules:
        words = [F.col(w).cast("string") if i % 2 else F.lit(w) for i, w in enumerate(re.split(r"{(\w+)}", text))]
        chosen = chosen.when(F.expr(condition), F.concat(*words)) if condition else chosen.otherwise(F.concat(*words))
    return chosen


def advice_rows(df: DataFrame, name: str, titles: dict[str, str], **lines: Column) -> DataFrame:
    """One summary row per snapshot to one row per advice line; the summary is computed once."""
    records = [F.struct(F.lit(titles.get(key, key)).alias("category"), text.alias(name)) for key, text in lines.items()]
    return df.select(*SNAP, F.inline(F.array(*records)))


@report("RM1", order="size_bytes desc, database_name")
def database_sizes(s: Snapshots) -> DataFrame:
    return s.database_stats.where(~F.col("datistemplate")).select(
        *SNAP, F.col("datname").alias("database_name"), pretty_bytes("size_bytes").alias("size"), "size_bytes",
        DATABASE_SIZE.column().alias("size_category"))


@report("RM2", order="bytes_value desc nulls last, parameter")
def memory_settings(s: Snapshots) -> DataFrame:
    return s.settings.where(F.col("name").isin(*MEMORY_SETTINGS)).select(
        *SNAP, F.col("name").alias("parameter"), F.col("setting").alias("configured_value"), "unit",
        setting_bytes().alias("bytes_value"), pretty_bytes(setting_bytes()).alias("size_pretty"),
        MEMORY_SETTING.column().alias("description"))


@report("RM3", order="buffers desc")
def buffer_cache_usage(s: Snapshots) -> DataFrame:
    kind = F.when(F.col("category") == "buffer content", F.concat("category", F.lit(" ("), "name", F.lit(")")))
    return with_settings(s.buffercache, s.settings, "shared_buffers").select(
        *SNAP, F.coalesce(kind, "category").alias("resource_type"), "buffers",
        pretty_bytes(F.col("buffers") * 8192).alias("size"),
        percent("buffers", as_number("shared_buffers")).alias("percent_of_shared_buffers"))


def session_counts(activity: DataFrame) -> DataFrame:
    """All state counts of a snapshot in one pass."""
    state = F.col("state")
    return activity.groupBy(*SNAP).agg(
        n_rows().alias("total"),
        F.count_if(state == "active").alias("active"),
        F.count_if(state == "idle").alias("idle"),
        F.count_if(state == "idle in transaction").alias("idle_tx"),
        F.count_if(state == "idle in transaction (aborted)").alias("aborted"),
        F.count_if(state.like("idle in transaction%")).alias("stuck"),
    )


@report("RM4")
def connection_kpis(s: Snapshots) -> DataFrame:
    counts = with_settings(session_counts(s.activity), s.settings, "max_connections")
    rows = F.array(*[F.struct(F.lit(title).alias("metric"), F.col(c).alias("current_value"))
                     for title, c in CONNECTION_KPIS.items()])
    limit = as_number("max_connections")
    return counts.select(*SNAP, F.inline(rows), limit.alias("max_configured")).withColumn(
        "percent_used", percent("current_value", "max_configured"))


@report("RM5", order="database_name")
def database_io(s: Snapshots) -> DataFrame:
    return s.database_stats.where(F.col("datname").isNotNull()).select(
        *SNAP, F.col("datname").alias("database_name"),
        F.col("blks_read").alias("blocks_read_from_disk"), F.col("blks_hit").alias("blocks_read_from_cache"),
        percent("blks_hit", F.col("blks_hit") + F.col("blks_read")).alias("cache_hit_ratio"),
        F.col("tup_returned").alias("tuples_returned"), F.col("tup_fetched").alias("tuples_fetched"),
        F.col("tup_inserted").alias("tuples_inserted"), F.col("tup_updated").alias("tuples_updated"),
        F.col("tup_deleted").alias("tuples_deleted"), CACHE_PERFORMANCE.column().alias("cache_performance"))


@report("RM6")
def table_io_top(s: Snapshots, k: int = 20) -> DataFrame:
    heap = F.col("heap_blks_read") + F.col("heap_blks_hit")
    blocks = s.table_stats.where(heap > 0).withColumn("_blocks", heap + F.col("idx_blks_read") + F.col("idx_blks_hit"))
    return top_k(blocks, k, F.col("_blocks").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", pretty_bytes("total_relation_size").alias("total_size"),
        F.col("total_relation_size").alias("size_bytes"), "heap_blks_read", "heap_blks_hit",
        percent("heap_blks_hit", heap).alias("cache_hit_ratio"), "idx_blks_read", "idx_blks_hit",
        percent("idx_blks_hit", F.col("idx_blks_hit") + F.col("idx_blks_read")).alias("index_hit_ratio"),
        "seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch")


@report("RM7")
def index_utilization(s: Snapshots, k: int = 25) -> DataFrame:
    return top_k(s.index_stats, k, F.col("index_size").desc_nulls_first(), F.col("index_name").asc()).select(
        *SNAP, "schemaname", "table_name", "index_name", pretty_bytes("index_size").alias("index_size"),
        F.col("idx_scan").alias("times_used"), F.col("idx_tup_read").alias("tuples_read"),
        F.col("idx_tup_fetch").alias("tuples_fetched"), INDEX_USAGE.column().alias("usage_category"),
        INDEX_RECOMMENDATION.column().alias("recommendation"))


@report("RM8")
def wal_kv(s: Snapshots) -> DataFrame:
    wide = with_settings(
        s.servers.select(*SNAP, "current_lsn"), s.settings, "wal_buffers", "checkpoint_segments", "max_wal_size")
    values = [F.col("current_lsn"), pretty_bytes(as_number("wal_buffers") * 8192), F.col("checkpoint_segments"), F.col("max_wal_size")]
    rows = F.array(*[
        F.struct(F.lit(title).alias("metric"), v.alias("current_value"), F.lit(text).alias("description"))
        for (title, text), v in zip(WAL_KV, values)])
    return wide.select(*SNAP, F.inline(rows))


@report("RM9")
def bgwriter_unpivot(s: Snapshots) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(title).alias("statistic"), F.col(c).alias("value"), F.lit(text).alias("description"))
        for c, (title, text) in BGWRITER.items()])
    return s.bgwriter.select(*SNAP, F.inline(rows))


@report("RM10", order="dead_tuple_ratio desc nulls last")
def maintenance_status(s: Snapshots, k: int = 20) -> DataFrame:
    used = s.table_stats.where(F.col("n_live_tup") + F.col("n_dead_tup") > 0).withColumn("dead_tuple_ratio", dead_percent())
    return top_k(used, k, F.col("dead_tuple_ratio").desc_nulls_last(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", F.col("n_tup_ins").alias("inserts"), F.col("n_tup_upd").alias("updates"),
        F.col("n_tup_del").alias("deletes"), F.col("n_live_tup").alias("live_tuples"), F.col("n_dead_tup").alias("dead_tuples"),
        "dead_tuple_ratio", "last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze",
        MAINTENANCE_STATUS.column().alias("maintenance_status"))


@report("RM11", order="lock_count desc")
def lock_modes(s: Snapshots) -> DataFrame:
    return s.locks.groupBy(*SNAP, F.col("mode").alias("lock_mode")).agg(
        n_rows().alias("lock_count"), F.count_if(~F.col("granted")).alias("waiting_locks"),
        F.array_join(F.sort_array(F.collect_set("locktype")), ", ").alias("lock_types"))


@report("RM12")
def resource_advice(s: Snapshots) -> DataFrame:
    sessions = s.activity.groupBy(*SNAP).agg(n_rows().alias("current_connections"))
    blocks = s.database_stats.groupBy(*SNAP).agg(F.sum("blks_hit").alias("hits"), F.sum("blks_read").alias("disk_reads"))
    limit = pivot_settings(s.settings, "max_connections").select(*SNAP, as_number("max_connections").alias("max_connections"))
    summary = (
        sessions.join(blocks, SNAP, "left").join(limit, SNAP, "left")
        .join(s.bgwriter.select(*SNAP, "checkpoints_req", "checkpoints_timed"), SNAP, "left"))
    return advice_rows(summary, "analysis", {}, connections=CONNECTION_ADVICE.column(), cache=CACHE_ADVICE.column(),
                       checkpoints=CHECKPOINT_ADVICE.column())


# --- bloat, cache, wraparound --------------------------------------------------

@report("BL1", order="dead_tuples desc")
def table_bloat(s: Snapshots, k: int = 50) -> DataFrame:
    return top_k(s.table_stats, k, F.col("n_dead_tup").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), pretty_bytes("total_relation_size").alias("total_size"),
        F.col("n_dead_tup").alias("dead_tuples"), F.col("n_live_tup").alias("live_tuples"),
        dead_percent().alias("dead_tuple_percent"), pretty_bytes("relation_size").alias("table_size"),
        "last_vacuum", "last_autovacuum")


@report("BL2", order="dead_tuple_percent desc")
def bloat_bands(s: Snapshots) -> DataFrame:
    return s.table_stats.select(
        *SNAP, qualified().alias("table_name"), F.col("n_dead_tup").alias("dead_tuples"),
        F.col("n_live_tup").alias("live_tuples"), dead_percent().alias("dead_tuple_percent"),
    ).withColumn("band", BLOAT_BAND.column())


@report("BU1")
def cache_hit_overall(s: Snapshots) -> DataFrame:
    read, hit = F.sum("heap_blks_read"), F.sum("heap_blks_hit")
    return s.table_stats.groupBy(*SNAP).agg(
        read.alias("heap_read"), hit.alias("heap_hit"),
        F.try_divide(hit.cast("double"), (hit + read).cast("double")).alias("ratio"))


@report("BU2", order="hit_percent, heap_blks_read desc")
def cache_hit_by_table(s: Snapshots, k: int = 20, by_volume: bool = False) -> DataFrame:
    blocks = F.col("heap_blks_hit") + F.col("heap_blks_read")
    active = s.table_stats.where(blocks > 0).withColumn("hit_percent", percent("heap_blks_hit", blocks))
    order = [blocks.desc_nulls_first()] if by_volume else [
        F.col("hit_percent").asc_nulls_last(), F.col("heap_blks_read").desc_nulls_first()]
    return top_k(active, k, *order, F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), "heap_blks_read", "heap_blks_hit", "hit_percent")


@report("TX1", order="age_in_transactions desc")
def database_xid_age(s: Snapshots) -> DataFrame:
    return s.database_stats.select(
        *SNAP, F.col("datname").alias("database_name"), F.col("xid_age").alias("age_in_transactions"),
        wraparound_percent("xid_age").alias("percent_towards_wraparound"),
        pretty_bytes("size_bytes").alias("database_size"), "size_bytes")


@report("TX2", order="age_in_transactions desc")
def table_xid_age(s: Snapshots, k: int = 20) -> DataFrame:
    return top_k(s.table_stats, k, F.col("xid_age").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), F.col("xid_age").alias("age_in_transactions"),
        wraparound_percent("xid_age").alias("percent_towards_wraparound"),
        pretty_bytes("total_relation_size").alias("total_size"), "last_vacuum", "last_autovacuum")


@report("TX3", order="overdue_by desc")
def freeze_overdue(s: Snapshots) -> DataFrame:
    aged = with_settings(
        s.table_stats.select(*SNAP, "relid", "schemaname", "table_name", "xid_age"), s.settings,
        "autovacuum_freeze_max_age", "vacuum_freeze_table_age")
    limit = F.least(as_number("autovacuum_freeze_max_age") + FREEZE_MARGIN, F.lit(WRAPAROUND_WARNING).cast("bigint"))
    return aged.where(F.col("xid_age") > limit).select(
        *SNAP, qualified().alias("table_name"), F.col("xid_age").alias("age_in_transactions"),
        (F.col("xid_age") - as_number("vacuum_freeze_table_age")).alias("overdue_by"))
