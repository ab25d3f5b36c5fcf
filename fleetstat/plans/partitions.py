"""Partition trees and their balance over ``partition_nodes``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, Ladder, older_than, pretty_bytes, qualified, n_rows
from fleetstat.operators.graphs import walk_tree
from fleetstat.operators.joins import pivot_settings
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

MB = 1024**2
WEEK = 7 * 86400

# Thresholds and labels of the partition reports.
STRATEGY = Ladder(
    ("partition_bound LIKE '%FOR VALUES FROM%'", "RANGE"), ("partition_bound LIKE '%FOR VALUES IN%'", "LIST"),
    ("partition_bound LIKE '%FOR VALUES WITH%'", "HASH"),
    default="OTHER",
)
SIZE_BALANCE = Ladder(
    ("size_stddev > 0.5 * avg_size", "HIGH VARIANCE: Unbalanced partition sizes"),
    ("size_stddev > 0.2 * avg_size", "MODERATE VARIANCE: Some size imbalance"),
    default="LOW VARIANCE: Well-balanced partitions",
)
COUNT_ASSESSMENT = Ladder(
    ("partition_count > 100", "WARNING: Many partitions may impact query planning performance"),
    ("partition_count < 2", "INFO: Very few partitions - consider partition strategy"),
    default="OK: Reasonable partition count",
)
HEALTH = Ladder(
    ("sequential_scans > index_scans AND estimated_rows > 10000", "CONSIDER INDEXES: High sequential scan activity"),
    ("estimated_rows = 0", "EMPTY: Consider dropping or archiving"),
    (f"total_size_bytes < {MB} AND estimated_rows < 1000", "SMALL: Consider consolidating with adjacent partitions"),
    default="OK: Normal partition usage",
)
PARTITION_MAINTENANCE = Ladder(
    ("last_vacuum < snap_ts - INTERVAL '7' DAY AND estimated_rows > 1000", "NEEDS VACUUM: No recent vacuum activity"),
    ("last_analyze < snap_ts - INTERVAL '7' DAY AND estimated_rows > 1000", "NEEDS ANALYZE: Statistics may be stale"),
    default="OK: Recent maintenance",
)
EXCLUSION = Ladder.lookup("constraint_exclusion", {
    "off": "CRITICAL: Enable constraint_exclusion for partition pruning",
    "on": "WARNING: constraint_exclusion=on may impact non-partitioned queries",
    "partition": "OPTIMAL: constraint_exclusion=partition is recommended",
}, "UNKNOWN: Check constraint_exclusion setting")
PRUNING = Ladder(
    ("total_partitions > 50", "Consider partition pruning optimization for large partition count"),
    default="Partition count should allow effective pruning",
)
RECOMMENDATION = Ladder(
    ("empty_partitions > 5", "Consider dropping empty partitions: DROP TABLE partition_name;"),
    ("small_partitions > 0.3 * partition_count", "Many small partitions - consider different partitioning strategy"),
    ("partitions_needing_vacuum > 0.5 * partition_count", "Schedule regular VACUUM maintenance across partitions"),
    ("partitions_needing_analyze > 0.5 * partition_count", "Schedule regular ANALYZE maintenance across partitions"),
    default="Partition maintenance appears current",
)
CLEANUP_MANY = "-- Automated monthly cleanup: drop empty partitions named like %s_%%"
CLEANUP_FEW = "-- Consider partition automation for tables with many partitions"
IMPACT = Ladder(
    ("total_partitions > 1000", "CAUTION: Very high partition count may impact metadata operations"),
    ("total_partitions > 500", "MONITOR: High partition count - watch query planning performance"),
    default="OK: Manageable partition count",
)


def partition_sizes(s: Snapshots) -> DataFrame:
    """Each partition with its parent's name, sizes, rows and bound."""
    nodes = s.partition_nodes
    parents = nodes.where(F.col("relkind") == "p").select(
        *SNAP, F.col("oid").alias("parent_oid"), qualified().alias("parent_table"))
    return nodes.where(F.col("parent_oid").isNotNull()).join(parents, [*SNAP, "parent_oid"]).select(
        *SNAP, "parent_table", qualified().alias("partition_name"), F.col("total_size").alias("partition_size"), "table_size",
        F.coalesce("n_live_tup", F.lit(0)).alias("row_count"), "partition_bound", "seq_scan", "seq_tup_read", "idx_scan",
        "idx_tup_fetch", "last_vacuum", "last_analyze")


@report("PM1", order="path, level")
def partition_hierarchy(s: Snapshots) -> DataFrame:
    nodes = s.partition_nodes.withColumn("name", qualified())
    walked = walk_tree(nodes.select(*SNAP, "oid", "parent_oid", "name"))
    facts = nodes.select(*SNAP, "oid", "name", "relkind", "total_size", "table_size", "n_live_tup")
    kind = F.when(F.col("level").isNull(), "UNREACHABLE").when(F.col("level") == 0, "ROOT").when(F.col("relkind") == "p", "INTERMEDIATE").otherwise("LEAF")
    return walked.join(facts, [*SNAP, "oid"]).select(
        *SNAP, F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(0))), "name").alias("partition_hierarchy"), "level",
        kind.alias("partition_type"), pretty_bytes("total_size").alias("total_size"),
        pretty_bytes("table_size").alias("table_size"), F.coalesce("n_live_tup", F.lit(0)).alias("estimated_rows"),
        F.size("path").alias("depth_in_hierarchy"), "path")


@report("PM2", order="total_bytes desc")
def partition_balance(s: Snapshots) -> DataFrame:
    size = F.col("partition_size")
    stats = partition_sizes(s).groupBy(*SNAP, "parent_table").agg(
        n_rows().alias("partition_count"), F.sum(size).alias("total_bytes"), F.avg(size).alias("avg_size"),
        F.stddev_samp(size).alias("size_stddev"), F.min(size).alias("smallest_bytes"), F.max(size).alias("largest_bytes"),
        F.sum("row_count").alias("total_estimated_rows"), F.round(F.avg("row_count")).alias("avg_rows_per_partition"))
    return stats.select(
        *SNAP, "parent_table", "partition_count", "total_bytes", "smallest_bytes", "largest_bytes",
        pretty_bytes("total_bytes").alias("total_partitioned_size"),
        pretty_bytes(F.round("avg_size")).alias("avg_partition_size"),
        pretty_bytes("smallest_bytes").alias("smallest_partition"), pretty_bytes("largest_bytes").alias("largest_partition"),
        SIZE_BALANCE.column().alias("size_balance_assessment"), "total_estimated_rows", "avg_rows_per_partition",
        COUNT_ASSESSMENT.column().alias("partition_count_assessment"))


@report("PM3", order="parent_table, total_size_bytes desc")
def partition_health(s: Snapshots) -> DataFrame:
    zero = F.lit(0)
    return partition_sizes(s).select(
        *SNAP, "parent_table", "partition_name", "partition_bound", F.col("partition_size").alias("total_size_bytes"),
        pretty_bytes("partition_size").alias("total_size"), pretty_bytes("table_size").alias("table_size"),
        F.col("row_count").alias("estimated_rows"), F.coalesce("seq_scan", zero).alias("sequential_scans"),
        F.coalesce("seq_tup_read", zero).alias("seq_tuples_read"), F.coalesce("idx_scan", zero).alias("index_scans"),
        F.coalesce("idx_tup_fetch", zero).alias("index_tuples_fetched"), "last_vacuum", "last_analyze",
    ).withColumn("partition_health", HEALTH.column()).withColumn("maintenance_status", PARTITION_MAINTENANCE.column())


@report("PM4")
def partition_strategy_summary(s: Snapshots) -> DataFrame:
    parts = s.partition_nodes.where(F.col("parent_oid").isNotNull()).withColumn("strategy", STRATEGY.column())
    counts = parts.groupBy(*SNAP).agg(
        n_rows().alias("total_partitions"), F.count_distinct("strategy").alias("partition_strategies_used"))
    return counts.join(pivot_settings(s.settings, "constraint_exclusion"), SNAP, "left").select(
        *SNAP, "total_partitions", "partition_strategies_used", F.col("constraint_exclusion").alias("constraint_exclusion_setting"),
        EXCLUSION.column().alias("configuration_assessment"), PRUNING.column().alias("pruning_efficiency_note"))


@report("PM5", order="partition_count desc")
def partition_advice(s: Snapshots) -> DataFrame:
    counts = partition_sizes(s).groupBy(*SNAP, "parent_table").agg(
        n_rows().alias("partition_count"), F.count_if(F.col("row_count") == 0).alias("empty_partitions"),
        F.count_if(F.col("partition_size") < MB).alias("small_partitions"),
        F.count_if(older_than("last_vacuum", WEEK)).alias("partitions_needing_vacuum"),
        F.count_if(older_than("last_analyze", WEEK)).alias("partitions_needing_analyze"),
        F.max("partition_size").alias("largest"), F.min("partition_size").alias("smallest"))
    cleanup = F.format_string(CLEANUP_MANY, F.replace("parent_table", F.lit("."), F.lit("_")))
    return counts.select(
        *SNAP, "parent_table", "partition_count", "empty_partitions", "small_partitions", "partitions_needing_vacuum",
        "partitions_needing_analyze", pretty_bytes("largest").alias("largest_partition"),
        pretty_bytes("smallest").alias("smallest_partition"), RECOMMENDATION.column().alias("primary_recommendation"),
        F.when(F.col("partition_count") > 12, cleanup).otherwise(CLEANUP_FEW).alias("automation_suggestion"))


@report("PM6")
def partition_totals(s: Snapshots) -> DataFrame:
    is_partition = F.col("parent_oid").isNotNull()
    totals = s.partition_nodes.groupBy(*SNAP).agg(
        F.count_distinct("parent_oid").alias("partitioned_tables"), F.count_if(is_partition).alias("total_partitions"),
        F.sum(F.when(is_partition, F.col("total_size"))).alias("partitioned_bytes"))
    return totals.select(
        *SNAP, "partitioned_tables", "total_partitions", "partitioned_bytes",
        pretty_bytes("partitioned_bytes").alias("total_partitioned_data"), IMPACT.column().alias("performance_impact"))
