"""Configuration assessment, export and tuning over ``settings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, Ladder, age_seconds, as_number, pretty_bytes, setting_bytes
from fleetstat.operators.joins import pivot_settings, shuffled
from fleetstat.plans.registry import report
from fleetstat.plans.resources import advice_rows, sentence
from fleetstat.sources.snapshots import Snapshots

GB, MB = 1024**3, 1024**2


def _on(name: str, *rules: tuple[str, str], otherwise: str | None = None) -> list[tuple[str, str]]:
    """Rules that hold for one setting only."""
    bound = [(f"name = '{name}' AND {p}", label) for p, label in rules]
    return bound + ([(f"name = '{name}'", otherwise)] if otherwise else [])


def _values(name: str, mapping: dict[str, str], otherwise: str | None) -> list[tuple[str, str]]:
    return _on(name, *[(f"setting = '{v}'", label) for v, label in mapping.items()], otherwise=otherwise)


# Settings of each assessment, thresholds and labels.
MEMORY_NAMES = ("shared_buffers", "work_mem", "maintenance_work_mem", "effective_cache_size", "wal_buffers",
                "max_connections", "shared_preload_libraries")
MEMORY = Ladder(
    *_on("shared_buffers", (f"bytes_value < {128 * MB}", "LOW - Consider 25% of RAM"),
         (f"bytes_value > {8 * GB}", "HIGH - May cause issues"), otherwise="REASONABLE"),
    *_on("work_mem", (f"bytes_value < {4 * MB}", "LOW - May cause temp files"),
         (f"bytes_value > {GB}", "HIGH - Risk of OOM"), otherwise="REASONABLE"),
    *_on("maintenance_work_mem", (f"bytes_value < {64 * MB}", "LOW - Slow maintenance ops"),
         (f"bytes_value > {2 * GB}", "HIGH - May be excessive"), otherwise="REASONABLE"),
    *_on("effective_cache_size", (f"bytes_value < {GB}", "LOW - Underestimating OS cache"),
         otherwise="Check if realistic for your system"),
    default="Review based on workload",
)
CONCURRENCY_NAMES = ("max_connections", "max_worker_processes", "max_parallel_workers",
                     "max_parallel_workers_per_gather", "max_parallel_maintenance_workers")
CONCURRENCY = Ladder(
    *_on("max_connections", ("num > 1000", "HIGH - Consider connection pooling"),
         ("num < 20", "LOW - May be insufficient"), otherwise="REASONABLE"),
    *_on("max_worker_processes", ("num < 8", "LOW - May limit parallelism"),
         ("num > 64", "HIGH - May be excessive"), otherwise="REASONABLE"),
    *_on("max_parallel_workers_per_gather", ("num = 0", "DISABLED - No parallel queries"),
         ("num > 8", "HIGH - Diminishing returns likely"), otherwise="REASONABLE"),
    default="Review based on workload",
)
DURABILITY_NAMES = ("wal_level", "fsync", "synchronous_commit", "wal_sync_method", "checkpoint_completion_target",
                    "checkpoint_timeout", "max_wal_size", "min_wal_size", "wal_buffers")
DURABILITY = Ladder(
    *_values("wal_level", {"minimal": "MINIMAL - No replication/archiving possible", "replica": "REPLICA - Standard for replication",
                           "logical": "LOGICAL - Enables logical replication"}, "UNKNOWN"),
    *_values("fsync", {"on": "SAFE - Ensures durability", "off": "DANGEROUS - Risk of data loss"}, "UNKNOWN"),
    *_values("synchronous_commit", {"on": "SAFE - Full durability", "off": "FAST - Risk of transaction loss",
                                    "local": "LOCAL - No sync with standby"}, "="),
    *_on("checkpoint_completion_target", ("num < 0.5", "LOW - May cause I/O spikes"),
         ("num > 0.9", "HIGH - May delay checkpoints"), otherwise="REASONABLE"),
    *_on("max_wal_size", (f"bytes_value < {GB}", "LOW - Frequent checkpoints"),
         (f"bytes_value > {100 * GB}", "HIGH - Long recovery time"), otherwise="REASONABLE"),
    default="Review based on requirements",
)
PLANNER_NAMES = ("random_page_cost", "seq_page_cost", "cpu_tuple_cost", "cpu_index_tuple_cost", "cpu_operator_cost",
                 "effective_io_concurrency", "default_statistics_target", "constraint_exclusion", "enable_seqscan", "enable_indexscan")
PLANNER = Ladder(
    *_on("random_page_cost", ("num = 4.0", "DEFAULT - Good for traditional disks"), ("num < 2.0", "LOW - Good for SSD storage"),
         ("num > 6.0", "HIGH - May favor index scans too much"), otherwise="CUSTOM"),
    *_on("seq_page_cost", ("num <> 1.0", "MODIFIED - Ensure random_page_cost ratio is correct"), otherwise="DEFAULT"),
    *_on("effective_io_concurrency", ("num = 1", "LOW - Good for single disk"), ("num > 1000", "HIGH - May be excessive"),
         otherwise="REASONABLE"),
    *_on("default_statistics_target", ("num < 100", "LOW - May cause poor plans"), ("num > 1000", "HIGH - Slower ANALYZE"),
         otherwise="REASONABLE"),
    default="Review based on storage and workload",
)
LOGGING_NAMES = ("logging_collector", "log_destination", "log_statement", "log_min_duration_statement", "log_checkpoints",
                 "log_connections", "log_disconnections", "log_lock_waits", "log_temp_files", "log_autovacuum_min_duration")
LOGGING = Ladder(
    *_values("log_statement", {"none": "NONE - No SQL logging", "ddl": "DDL - Only schema changes",
                               "mod": "MODIFICATIONS - DML and DDL", "all": "ALL - Performance impact, use carefully"}, "UNKNOWN"),
    *_on("log_min_duration_statement", ("num = -1", "DISABLED - No slow query logging"), ("num = 0", "ALL - Logs every statement"),
         ("num > 10000", "HIGH - Only very slow queries"), otherwise="ENABLED - Threshold: =ms"),
    *_values("log_checkpoints", {"on": "ENABLED - Good for monitoring", "off": "DISABLED - Consider enabling"}, "UNKNOWN"),
    default="Review based on monitoring needs",
)
AUTOVACUUM = Ladder(
    *_values("autovacuum", {"on": "ENABLED - Essential for maintenance", "off": "DISABLED - Dangerous, enable immediately"}, "UNKNOWN"),
    *_on("autovacuum_max_workers", ("num < 3", "LOW - May cause maintenance backlogs"), ("num > 10", "HIGH - May cause I/O contention"),
         otherwise="REASONABLE"),
    *_on("autovacuum_vacuum_threshold", ("num > 100", "HIGH - Large tables may not vacuum"), otherwise="REASONABLE"),
    *_on("autovacuum_vacuum_scale_factor", ("num > 0.4", "HIGH - Tables may accumulate dead tuples"),
         ("num < 0.1", "LOW - Very frequent vacuuming"), otherwise="REASONABLE"),
    default="Review based on workload patterns",
)
SECURITY_NAMES = ("ssl", "password_encryption", "row_security", "log_statement_stats", "track_activities", "track_counts")
SECURITY = Ladder(
    *_values("ssl", {"on": "ENABLED - Secure connections available", "off": "DISABLED - Consider enabling for security"}, "UNKNOWN"),
    *_values("password_encryption", {"scram-sha-256": "SECURE - Modern encryption", "md5": "LEGACY - Consider upgrading to scram-sha-256"},
             "CHECK - Verify encryption method"),
    *_values("row_security", {"on": "ENABLED - Row Level Security available", "off": "DISABLED - No RLS enforcement"}, "UNKNOWN"),
    default="Review security requirements",
)
EXTENSION_USE = Ladder.lookup("extname", {
    "pg_stat_statements": "Query performance monitoring", "pg_buffercache": "Buffer cache inspection",
    "pgstattuple": "Tuple statistics", "auto_explain": "Automatic query plan logging", "pg_prewarm": "Buffer prewarming",
    "pg_hint_plan": "Query plan hinting"}, "See PostgreSQL documentation")
ADVICE_TITLES = {
    "memory": "MEMORY RECOMMENDATIONS:", "connection": "CONNECTION RECOMMENDATIONS:", "durability": "DURABILITY RECOMMENDATIONS:",
    "maintenance": "MAINTENANCE RECOMMENDATIONS:", "monitoring": "MONITORING RECOMMENDATIONS:",
}
# Advice sentences and when they hold.
MEMORY_ADVICE = (
    (f"buffers < {128 * MB}", "shared_buffers too low - recommend 25% of RAM (current: {buffers_size})"),
    (f"buffers > {8 * GB}", "shared_buffers very high - may cause performance issues (current: {buffers_size})"),
    (None, "shared_buffers appears reasonable"),
)
CONNECTION_ADVICE = (
    ("connections > 1000", "max_connections very high ({connections}) - strongly recommend connection pooling"),
    ("connections > 200", "max_connections high ({connections}) - consider connection pooling"),
    (None, "max_connections appears reasonable ({connections})"),
)
DURABILITY_ADVICE = Ladder(
    ("fsync = 'off'", "CRITICAL: fsync is OFF - data loss risk! Enable immediately"), default="fsync properly enabled for data safety")
MAINTENANCE_ADVICE = Ladder(
    ("autovacuum = 'off'", "CRITICAL: autovacuum is DISABLED - enable immediately to prevent table bloat"),
    default="autovacuum properly enabled")
MONITORING_ADVICE = Ladder(
    ("statement_extensions = 0", "Install pg_stat_statements extension for query performance monitoring"),
    default="pg_stat_statements extension installed - good for monitoring")
DEFAULT_RAM = 8 * GB
# Percent of memory for buffers, connections, and percent of memory for caches, by workload.
WORKLOADS = {
    "oltp": (20, 200, 60),
    "olap": (25, 50, 75),
    "web": (15, 100, 60),
    "mixed": (20, 100, 60),
}
# Settings of one value, for a workload or for all (None).
LISTED_TUNING = [
    (None, "checkpoint_completion_target", "0.9"),
    (None, "random_page_cost", "1.1"),
    ("oltp", "max_wal_size", "4GB"),
    ("oltp", "effective_io_concurrency", "200"),
    ("oltp", "default_statistics_target", "100"),
    ("olap", "max_wal_size", "8GB"),
    ("olap", "effective_io_concurrency", "200"),
    ("olap", "default_statistics_target", "500"),
    ("olap", "max_parallel_workers_per_gather", "4"),
    ("olap", "max_parallel_workers", "8"),
    ("web", "max_wal_size", "2GB"),
    ("web", "effective_io_concurrency", "100"),
    ("web", "default_statistics_target", "200"),
    ("mixed", "max_wal_size", "4GB"),
    ("mixed", "effective_io_concurrency", "200"),
    ("mixed", "default_statistics_target", "200"),
]
# Computed settings and the column each is read from; those in megabytes end in _mb.
COMPUTED_TUNING = {"shared_buffers": "buffers_mb", "work_mem": "work_mb", "maintenance_work_mem": "maintenance_mb",
                   "effective_cache_size": "cache_mb", "max_connections": "connections"}
TUNED_NAMES = sorted({*COMPUTED_TUNING, *(name for _, name, _ in LISTED_TUNING)})
DRIFT = Ladder(
    (f"name = 'shared_buffers' AND bytes_value < {128 * MB}", "Increase to ~25% of RAM"),
    (f"name = 'work_mem' AND bytes_value < {4 * MB}", "Consider increasing for complex queries"),
    ("name = 'max_connections' AND num > 200", "Consider connection pooling"),
    default=None,
)


def _assess(s: Snapshots, chosen: Column, ladder: Ladder) -> DataFrame:
    """Settings with an assessment; '=' in a label stands for the setting itself."""
    values = s.settings.where(chosen).withColumn("num", as_number("setting", "double")).withColumn("bytes_value", setting_bytes())
    return values.select(
        *SNAP, F.col("name").alias("parameter"), F.col("setting").alias("current_value"), "unit", "source",
        F.col("short_desc").alias("description"),
        F.replace(ladder.column(), F.lit("="), F.coalesce("setting", F.lit(""))).alias("assessment"))


@report("CA1")
def server_info(s: Snapshots) -> DataFrame:
    paths = pivot_settings(s.settings, "server_version_num", "data_directory", "config_file")
    return s.servers.join(paths, SNAP, "left").select(
        *SNAP, F.col("version").alias("postgresql_version"), as_number("server_version_num").alias("version_number"),
        "data_directory", "config_file", F.col("started_at").alias("server_start_time"),
        F.call_function("div", age_seconds("started_at"), F.lit(3600)).alias("uptime_hours"))


@report("CA2", order="bytes_value desc nulls last")
def memory_assessment(s: Snapshots) -> DataFrame:
    values = s.settings.where(F.col("name").isin(*MEMORY_NAMES)).withColumn("bytes_value", setting_bytes())
    return values.select(
        *SNAP, F.col("name").alias("parameter"), F.concat("setting", F.coalesce(F.concat(F.lit(" "), "unit"), F.lit(""))).alias("current_value"),
        "bytes_value", pretty_bytes("bytes_value").alias("size_pretty"), F.col("source").alias("config_source"),
        F.col("short_desc").alias("description"), MEMORY.column().alias("assessment"))


@report("CA3", order="parameter")
def concurrency_assessment(s: Snapshots) -> DataFrame:
    return _assess(s, F.col("name").isin(*CONCURRENCY_NAMES), CONCURRENCY)


@report("CA4", order="parameter")
def durability_assessment(s: Snapshots) -> DataFrame:
    return _assess(s, F.col("name").isin(*DURABILITY_NAMES), DURABILITY)


@report("CA5", order="parameter")
def planner_assessment(s: Snapshots) -> DataFrame:
    return _assess(s, F.col("name").isin(*PLANNER_NAMES), PLANNER)


@report("CA6", order="parameter")
def logging_assessment(s: Snapshots) -> DataFrame:
    return _assess(s, F.col("name").isin(*LOGGING_NAMES), LOGGING)


@report("CA7", order="parameter")
def autovacuum_assessment(s: Snapshots) -> DataFrame:
    return _assess(s, F.col("name").like("autovacuum%"), AUTOVACUUM)


@report("CA8", order="extension_name")
def extension_features(s: Snapshots) -> DataFrame:
    return s.extensions.select(
        *SNAP, F.col("extname").alias("extension_name"), F.col("extversion").alias("version"), F.col("schemaname").alias("schema"),
        EXTENSION_USE.column().alias("description"))


@report("CA9", order="parameter")
def security_settings(s: Snapshots) -> DataFrame:
    return _assess(s, F.col("name").isin(*SECURITY_NAMES), SECURITY)


@report("CA10")
def configuration_advice(s: Snapshots) -> DataFrame:
    wide = pivot_settings(s.settings, "shared_buffers", "max_connections", "wal_level", "fsync", "autovacuum", units=True)
    installed = s.extensions.where(F.col("extname") == "pg_stat_statements").groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("statement_extensions"))
    facts = wide.join(installed, SNAP, "left").fillna(0, ["statement_extensions"]).withColumn(
        "buffers", setting_bytes("shared_buffers", "shared_buffers_unit")).withColumn("connections", as_number("max_connections"))
    return advice_rows(
        facts.withColumn("buffers_size", pretty_bytes("buffers")), "recommendation", ADVICE_TITLES,
        memory=sentence(MEMORY_ADVICE), connection=sentence(CONNECTION_ADVICE),
        durability=DURABILITY_ADVICE.column(), maintenance=MAINTENANCE_ADVICE.column(), monitoring=MONITORING_ADVICE.column())


@report("ES1")
def server_metadata(s: Snapshots) -> DataFrame:
    return s.servers.select(*SNAP, "host", "port", "version", F.col("snap_ts").alias("exported_at"))


@report("ES2", order="category, name")
def all_settings(s: Snapshots) -> DataFrame:
    return s.settings.select(
        *SNAP, "category", "name", "setting", "unit", "short_desc", "context", "vartype", "source", "boot_val", "pending_restart")


@report("ES3", order="category, name")
def overridden_settings(s: Snapshots, exclude_sources: tuple[str, ...] = ("default",)) -> DataFrame:
    return s.settings.where(~F.col("source").isin(*exclude_sources)).select(
        *SNAP, "category", "name", "setting", "unit", "boot_val", "source", "pending_restart")


@report("ES4")
def settings_document(s: Snapshots) -> DataFrame:
    """One JSON array per server, ordered by category and name; a server has a few hundred settings."""
    record = F.struct("category", "name", "setting", "unit", "context", "source", "boot_val", "pending_restart")
    docs = s.settings.groupBy(*SNAP).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("body"))
    parsed = F.from_json("body", "array<struct<category:string,name:string,setting:string>>")
    return docs.select(
        *SNAP, F.size(parsed).cast("bigint").alias("setting_count"),
        F.array_join(F.transform(parsed, lambda r: F.concat_ws("=", r["name"], r["setting"])), ";").alias("settings_in_order"))


def _tuned(servers: DataFrame) -> DataFrame:
    """Recommended values per server in whole megabytes."""
    ram_gb = F.call_function("div", F.when(F.col("ram_bytes") > 0, F.col("ram_bytes")).otherwise(DEFAULT_RAM), F.lit(GB))
    ram_mb = F.col("ram_gb") * 1024

    def by_workload(position: int) -> Column:
        chain = F
        for name, values in WORKLOADS.items():
            if name != "mixed":
                chain = chain.when(F.col("workload") == name, F.lit(values[position]))
        return chain.otherwise(F.lit(WORKLOADS["mixed"][position]))

    known = F.when(F.col("workload").isin(*WORKLOADS), F.col("workload")).otherwise("mixed")
    listed = F.filter(
        F.array(*[F.struct(F.lit(w).cast("string").alias("workload"), F.lit(n).alias("name"), F.lit(v).alias("recommended")) for w, n, v in LISTED_TUNING]),
        lambda row: row["workload"].isNull() | (row["workload"] == known))
    div = lambda a, b: F.call_function("div", a, b)
    return servers.withColumn("ram_gb", ram_gb).select(
        *SNAP, by_workload(1).cast("bigint").alias("connections"), listed.alias("listed"),
        div(ram_mb * by_workload(0), F.lit(100)).alias("buffers_mb"),
        F.greatest(F.lit(4), F.least(F.lit(512), div(div(ram_mb, by_workload(1)), F.lit(4)))).alias("work_mb"),
        F.greatest(F.lit(64), F.least(F.lit(2048), div(ram_mb * 8, F.lit(100)))).alias("maintenance_mb"),
        div(ram_mb * by_workload(2), F.lit(100)).alias("cache_mb"))


@report("PT1", order="server_id, name")
def recommend_settings(s: Snapshots) -> DataFrame:
    text = lambda c: F.concat(F.col(c).cast("string"), F.lit("MB" if c.endswith("_mb") else ""))
    computed = F.array(*[F.struct(F.lit(n).alias("name"), text(c).alias("recommended")) for n, c in COMPUTED_TUNING.items()])
    listed = F.transform("listed", lambda row: F.struct(row["name"].alias("name"), row["recommended"].alias("recommended")))
    return _tuned(s.servers).select(*SNAP, F.inline(F.concat(computed, listed)))


@report("PT2", order="server_id, name")
def settings_drift(s: Snapshots) -> DataFrame:
    """Current value, recommended value and a note for every tunable setting of every server; NULL for one the server lacks."""
    tuned = s.settings.where(F.col("name").isin(*TUNED_NAMES))
    current = tuned.withColumn("num", as_number("setting", "double")).withColumn("bytes_value", setting_bytes()).select(
        *SNAP, "name", F.concat("setting", F.coalesce("unit", F.lit(""))).alias("current_value"), "source",
        DRIFT.column().alias("note"))
    return recommend_settings(s).join(shuffled(current), [*SNAP, "name"], "left").select(
        *SNAP, "name", "current_value", "recommended", "source", "note")
