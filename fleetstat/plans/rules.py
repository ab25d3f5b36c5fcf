"""Documented alert thresholds as one small table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MB, GB = 1024**2, 1024**3

# Fixed values: (rule set, metric, low, high, bounds included, severity, must last seconds).
# A rule fires while low < value < high, or low <= value <= high where bounds are included.
ALERT_RULES = [
    ("AL1", "blocked_seconds", 300.0, None, False, "CRITICAL", 0),
    ("AL1", "sync_replication_lag_seconds", 300.0, None, False, "CRITICAL", 0),
    ("AL1", "xid_percent", 75.0, None, False, "CRITICAL", 0),
    ("AL1", "cache_hit_percent", None, 85.0, False, "CRITICAL", 0),
    ("AL1", "bloat_percent", 50.0, None, False, "CRITICAL", 0),
    ("AL2", "blocked_seconds", 60.0, None, False, "WARNING", 0),
    ("AL2", "async_replication_lag_seconds", 600.0, None, False, "WARNING", 0),
    ("AL2", "xid_percent", 40.0, None, False, "WARNING", 0),
    ("AL2", "cache_hit_percent", 85.0, 95.0, True, "WARNING", 0),
    ("AL2", "bloat_percent", 20.0, 50.0, True, "WARNING", 0),
    ("AL3", "idle_in_transaction_percent", 5.0, None, False, "MONITOR", 0),
    ("AL3", "index_bloat_percent", 10.0, None, False, "MONITOR", 0),
    ("AL3", "pool_efficiency_percent", None, 80.0, False, "MONITOR", 0),
    ("AL4", "sync_replication_lag_seconds", 300.0, None, False, "CRITICAL", 0),
    ("AL4", "replication_lag_bytes", float(2 * GB), None, False, "CRITICAL", 0),
    ("AL4", "inactive_slot_lag_bytes", float(10 * GB), None, False, "CRITICAL", 0),
    ("AL4", "active_replicas", None, 1.0, False, "CRITICAL", 0),
    ("AL4", "sync_replication_lag_seconds", 60.0, None, False, "WARNING", 0),
    ("AL4", "async_replication_lag_seconds", 600.0, None, False, "WARNING", 0),
    ("AL4", "replication_lag_bytes", float(GB), None, False, "WARNING", 0),
    ("AL4", "standby_catchup", 0.0, None, False, "WARNING", 1800),
    ("AL4", "replication_lag_seconds", 30.0, None, False, "MONITOR", 300),
    ("AL5", "access_exclusive_locks_in_business_hours", 0.0, None, False, "CRITICAL", 0),
    ("AL5", "blocked_seconds", 300.0, None, False, "CRITICAL", 0),
    ("AL5", "waiters_on_object", 1.0, None, False, "CRITICAL", 0),
    ("AL5", "locks_held_idle_in_transaction", 0.0, None, False, "CRITICAL", 0),
    ("AL6", "connection_percent", 80.0, None, False, "WARNING", 0),
    ("AL6", "bloat_percent", 20.0, None, False, "WARNING", 0),
    ("AL6", "replication_lag_bytes", float(100 * MB), None, False, "WARNING", 0),
    ("AL6", "xid_age", 500_000_000.0, None, False, "WARNING", 0),
    ("AL7", "ungranted_locks", 0.0, None, False, "CRITICAL", 0),
    ("AL7", "max_replication_lag_seconds", 300.0, None, False, "WARNING", 0),
    # For metrics sampled over time.
    ("TREND", "xid_percent", 750.0, None, False, "CRITICAL", 0),
    ("TREND", "replication_lag_s", 600.0, None, False, "WARNING", 1800),
    ("TREND", "blocked_s", 300.0, None, False, "CRITICAL", 300),
    ("TREND", "cache_hit_percent", None, 85.0, False, "CRITICAL", 0),
]

SCHEMA = ("rule_set string, metric string, low double, high double, inclusive boolean, severity string, for_seconds bigint")


def alert_rules(spark: SparkSession, *rule_sets: str) -> DataFrame:
    """The rules as a frame: a few dozen rows, so joins with it are broadcast."""
    chosen = [r for r in ALERT_RULES if not rule_sets or r[0] in rule_sets]
    return spark.createDataFrame(chosen, SCHEMA)
