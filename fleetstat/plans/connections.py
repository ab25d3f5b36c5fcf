"""Connection pools over ``activity``, ``settings`` and ``database_stats``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, Ladder, age_seconds, any_of, as_number, older_than, percent, pretty_bytes, n_rows
from fleetstat.operators.joins import with_settings
from fleetstat.operators.ranking import with_total
from fleetstat.plans.registry import report
from fleetstat.plans.resources import sentence, session_counts
from fleetstat.plans.waits import exclude_self
from fleetstat.sources.snapshots import Snapshots


# Thresholds and labels of the connection reports.
UTILIZATION = Ladder(
    ("total_connections > 0.8 * max_connections", "CRITICAL: >80% connection limit used"),
    ("total_connections > 0.6 * max_connections", "WARNING: >60% connection limit used"),
    default="OK: Connection usage within limits",
)
PATTERN = Ladder(
    ("idle_in_tx_count > 5", "WARNING: Many idle-in-transaction connections"),
    ("max_connection_age_seconds > 3600", "NOTICE: Long-lived connections detected"),
    default="Normal connection pattern",
)
CONNECTION_STATUS = Ladder(
    ("state = 'idle in transaction' AND state_change < snap_ts - INTERVAL '5' MINUTE",
     "CRITICAL: Long idle-in-transaction (potential leak)"),
    ("state = 'idle in transaction (aborted)'", "ERROR: Aborted transaction (needs cleanup)"),
    ("state = 'active' AND query_start < snap_ts - INTERVAL '30' MINUTE", "WARNING: Very long-running query"),
    ("state = 'idle' AND state_change < snap_ts - INTERVAL '2' HOUR", "NOTICE: Very long idle connection"),
    default="Normal",
)
STATE_RANK = Ladder(
    ("state = 'idle in transaction (aborted)'", "1"), ("state = 'idle in transaction'", "2"), ("state = 'active'", "3"), default="4")
EFFICIENCY = Ladder(
    ("active_connections > 0.8 * total_connections", "Excellent: High connection utilization"),
    ("active_connections > 0.5 * total_connections", "Good: Decent connection utilization"),
    ("active_connections > 0.2 * total_connections", "Fair: Some idle connections"),
    default="Poor: Many idle connections - consider connection pooling",
)
CONNECTION_HEALTH = Ladder(
    ("problematic_connections > 10", "CRITICAL: Many problematic connections - investigate application logic"),
    ("problematic_connections > 5", "WARNING: Some problematic connections"),
    default="OK: Few problematic connections",
)
BENEFIT = Ladder(
    ("total_backend_connections > 5 * unique_db_user_combinations",
     "High potential for pooling benefits - many connections per user/db"),
    ("total_backend_connections > 2 * unique_db_user_combinations", "Moderate potential for pooling benefits"),
    default="Limited pooling benefits - consider application-level optimization",
)
TEMPLATES = ("template0", "template1")


@report("CP1")
def connection_utilization(s: Snapshots) -> DataFrame:
    counts = with_settings(session_counts(s.activity), s.settings, "max_connections")
    return counts.select(
        *SNAP, F.col("total").alias("total_connections"), F.col("active").alias("active_connections"),
        F.col("idle").alias("idle_connections"), F.col("idle_tx").alias("idle_in_transaction"),
        F.col("aborted").alias("idle_in_transaction_aborted"), as_number("max_connections").alias("max_connections"),
    ).withColumn("connection_utilization_percent", percent("total_connections", "max_connections")).withColumn(
        "utilization_status", UTILIZATION.column())


@report("CP2", order="connection_count desc, idle_in_tx_count desc")
def connection_patterns(s: Snapshots) -> DataFrame:
    state, age = F.col("state"), age_seconds("backend_start")
    groups = exclude_self(s.activity).groupBy(*SNAP, "datname", "application_name", "usename", "client_addr").agg(
        n_rows().alias("connection_count"), F.count_if(state == "active").alias("active_count"),
        F.count_if(state == "idle").alias("idle_count"), F.count_if(state.like("idle in transaction%")).alias("idle_in_tx_count"),
        F.round(F.avg(age)).alias("avg_connection_age_seconds"), F.max(age).alias("max_connection_age_seconds"))
    return groups.where(F.col("connection_count") > 1).select(
        *SNAP, F.col("datname").alias("database_name"), "application_name", F.col("usename").alias("username"), "client_addr",
        "connection_count", "active_count", "idle_count", "idle_in_tx_count", "avg_connection_age_seconds",
        "max_connection_age_seconds", PATTERN.column().alias("pattern_assessment"))


@report("CP3", order="state_rank, state_change")
def problem_connections(s: Snapshots) -> DataFrame:
    state = F.col("state")
    problem = any_of(
        (state == "idle in transaction") & older_than("state_change", 60),
        state == "idle in transaction (aborted)",
        (state == "active") & older_than("query_start", 300),
        older_than("backend_start", 3600))
    return exclude_self(s.activity).where(problem).select(
        *SNAP, "pid", "usename", "datname", "application_name", "client_addr", "state", "backend_start", "query_start",
        "state_change", age_seconds("backend_start").alias("connection_age_seconds"),
        age_seconds("query_start").alias("query_age_seconds"), age_seconds("state_change").alias("state_age_seconds"),
        CONNECTION_STATUS.column().alias("connection_status"), STATE_RANK.column().alias("state_rank"),
        F.left("query", F.lit(100)).alias("query_snippet"))


@report("CP4")
def pool_efficiency(s: Snapshots) -> DataFrame:
    ages = s.activity.groupBy(*SNAP).agg(F.round(F.avg(age_seconds("backend_start"))).alias("avg_connection_age_seconds"))
    counts = session_counts(s.activity).join(ages, SNAP)
    total = F.col("total_connections")
    return with_settings(counts, s.settings, "max_connections").select(
        *SNAP, F.col("total").alias("total_connections"), F.col("active").alias("active_connections"),
        F.col("idle").alias("idle_connections"), F.col("stuck").alias("problematic_connections"), "avg_connection_age_seconds",
        as_number("max_connections").alias("max_connections"),
    ).select(
        "*", percent("active_connections", total).alias("active_percentage"), percent("idle_connections", total).alias("idle_percentage"),
        percent("problematic_connections", total).alias("problematic_percentage"), EFFICIENCY.column().alias("pool_efficiency"),
        CONNECTION_HEALTH.column().alias("connection_health"))


@report("CP5", order="total_transactions desc")
def transaction_churn(s: Snapshots) -> DataFrame:
    transactions = F.col("xact_commit") + F.col("xact_rollback")
    blocks = F.col("blks_read") + F.col("blks_hit")
    zero = F.lit(0.0)
    return s.database_stats.where(~F.col("datname").isin(*TEMPLATES)).select(
        *SNAP, F.col("datname").alias("database_name"), F.col("numbackends").alias("current_backends"),
        transactions.alias("total_transactions"), F.col("xact_commit").alias("committed_transactions"),
        F.col("xact_rollback").alias("rolled_back_transactions"),
        F.coalesce(percent("xact_rollback", transactions), zero).alias("rollback_percentage"), blocks.alias("total_block_access"),
        F.coalesce(percent("blks_hit", blocks), zero).alias("cache_hit_ratio"), "deadlocks", "temp_files",
        pretty_bytes("temp_bytes").alias("temp_data_size"), "stats_reset")


# Advice sentences and when they hold.
MANY_IDLE, NEARLY_FULL, STUCK = "idle > 2 * active", "total > 0.8 * limit", "stuck > 5"
POOL_ADVICE = (
    (MANY_IDLE, "Consider connection pooling: {idle} idle vs {active} active connections"),
    (NEARLY_FULL, "Increase max_connections or implement pooling: {total}/{limit} connections used"),
    (STUCK, "Fix application logic: {stuck} idle-in-transaction connections detected"),
    ("app_count > 10", "Consider connection multiplexing: {app_count} different applications connecting"),
    (None, "Connection usage appears optimal"),
)
POOL_GUIDANCE = (
    (MANY_IDLE, "Suggested pool size: {pool_size} connections per database"),
    (NEARLY_FULL, "Consider PgBouncer with pool_mode=transaction for better efficiency"),
    (STUCK, "Review application transaction management and connection handling"),
    (None, "Monitor connection patterns and adjust as workload changes"),
)


@report("CP6")
def pool_advice(s: Snapshots) -> DataFrame:
    mine = exclude_self(s.activity)
    variety = mine.groupBy(*SNAP).agg(
        F.count_distinct("application_name").alias("app_count"), F.count_distinct("client_addr").alias("client_count"))
    c = with_settings(session_counts(mine).join(variety, SNAP), s.settings, "max_connections").withColumn(
        "limit", as_number("max_connections"))
    pool = F.greatest(F.col("active") + 2, F.lit(5))
    return c.withColumn("pool_size", pool).select(
        *SNAP, F.col("total").alias("total_connections"), "app_count", "client_count",
        sentence(POOL_ADVICE).alias("primary_recommendation"), sentence(POOL_GUIDANCE).alias("detailed_guidance"))


@report("CP7")
def pooling_benefit(s: Snapshots) -> DataFrame:
    state = F.col("state")
    totals = exclude_self(s.activity).groupBy(*SNAP).agg(
        n_rows().alias("total_backend_connections"),
        # As one struct value, so that rows with a missing part are counted too.
        F.count_distinct(F.struct("datname", "usename")).alias("unique_db_user_combinations"),
        F.round(F.avg(age_seconds("backend_start"))).alias("avg_backend_age_seconds"),
        F.count_if(state == "active").alias("would_be_server_active"), F.count_if(state != "active").alias("would_be_server_idle"))
    pool = F.greatest(F.col("would_be_server_active") + 2, F.lit(5))
    return totals.select(
        "*", BENEFIT.column().alias("pooling_benefit_assessment"),
        F.format_string("Estimated pool size needed: %d per database", pool).alias("suggested_pool_config"))


@report("CP8", order="connection_start_hour")
def connections_by_hour(s: Snapshots) -> DataFrame:
    mine = exclude_self(s.activity)
    recent = mine.where(~older_than("backend_start", 86400) & (F.col("backend_start") != F.expr("snap_ts - INTERVAL '24' HOUR")))
    hours = recent.groupBy(*SNAP, F.hour("backend_start").alias("connection_start_hour")).agg(
        n_rows().alias("connections_started"), F.count_if(F.col("state") == "active").alias("currently_active"),
        F.round(F.avg(age_seconds("backend_start"))).cast("bigint").alias("avg_age_seconds"))
    return with_total(hours, mine, _all=n_rows()).select(
        *SNAP, "connection_start_hour", "connections_started", "currently_active", "avg_age_seconds",
        F.when(F.col("connections_started") > 0.2 * F.col("_all"), "Peak connection period")
        .otherwise("Normal connection period").alias("period_classification"))
