"""Vacuum and analyze planning over ``table_stats``. Plans are text; nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, Ladder, any_of, as_number, latest_of, match_globs, older_than, parse_bytes, percent, pretty_bytes, qualified,
)
from fleetstat.operators.joins import pivot_settings
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.plans.resources import GB, advice_rows, dead_percent, sentence
from fleetstat.sources.snapshots import Snapshots

MB = 1024**2
WEEK = 7 * 86400
CHANGES = "n_tup_ins + n_tup_upd + n_tup_del"
UNANALYZED = "last_analyze IS NULL AND last_autoanalyze IS NULL"
LATEST = "greatest(last_analyze, last_autoanalyze)"

# Thresholds and labels of the maintenance reports.
VACUUM_PRIORITY = Ladder(
    ("n_dead_tup > 0.5 * n_live_tup", "URGENT"), ("n_dead_tup > 0.2 * n_live_tup", "HIGH"),
    ("n_dead_tup > 0.1 * n_live_tup", "MODERATE"),
    default="LOW",
)
TABLE_SIZE = Ladder(
    (f"total_relation_size > {10 * GB}", "LARGE_TABLE"), (f"total_relation_size > {GB}", "MEDIUM_TABLE"), default="SMALL_TABLE")
ANALYZE_PRIORITY = Ladder(
    (UNANALYZED, "NEVER_ANALYZED"),
    (f"{LATEST} < snap_ts - INTERVAL '30' DAY AND {CHANGES} > 10000", "VERY_STALE"),
    (f"{LATEST} < snap_ts - INTERVAL '7' DAY AND {CHANGES} > 1000", "STALE"),
    (f"{CHANGES} > 0.1 * n_live_tup", "HIGH_CHANGES"),
    default="OK",
)
PLAN_PRIORITY = Ladder(
    (UNANALYZED, "NEVER"),
    (f"{LATEST} < snap_ts - INTERVAL '7' DAY AND {CHANGES} > 1000", "OUTDATED"),
    (f"{CHANGES} > 0.1 * n_live_tup", "HIGH_CHANGES"),
    default="OK",
)
BLOAT_STATUS = Ladder(("idx_scan = 0", "UNUSED"), ("index_size = 0", "EMPTY"), default="NORMAL")
REINDEX = Ladder(
    (f"idx_scan = 0 AND index_size > {100 * MB}", "CONSIDER_DROPPING"),
    (f"idx_scan = 0 AND index_size > {10 * MB}", "REVIEW_USAGE"),
    ("idx_scan > 0 AND idx_tup_read > 10 * idx_tup_fetch", "POSSIBLE_BLOAT"),
    default="OK",
)
URGENCY = Ladder(
    ("tables_urgent_vacuum > 5", "HIGH - Immediate attention needed"),
    ("tables_need_vacuum > 10", "MODERATE - Schedule maintenance soon"),
    ("tables_need_vacuum > 0", "LOW - Regular maintenance sufficient"),
    default="MINIMAL - System healthy",
)
#: Section of the advice report: its title, and sentences in order with the condition of each; {name} is a column.
ADVICE = {
    "immediate": ("IMMEDIATE ACTIONS RECOMMENDED:", (
        ("urgent > 0", "Run VACUUM on {urgent} tables with >20% dead tuples immediately"),
        (None, "No urgent VACUUM operations needed"))),
    "regular": ("REGULAR MAINTENANCE:", (
        ("vacuum > 0", "Schedule VACUUM for {vacuum} tables during maintenance window"),
        (None, "No additional VACUUM operations needed"))),
    "statistics": ("STATISTICS UPDATES:", (
        ("stale > 0", "Run ANALYZE on {stale} tables to update query planner statistics"),
        (None, "Table statistics are current"))),
    "autovacuum": ("AUTOVACUUM STATUS:", (
        ("autovacuum = 'off'", "CRITICAL: Autovacuum is disabled - enable immediately!"),
        ("workers < 3 AND vacuum > 10", "Consider increasing autovacuum_max_workers (current: {workers})"),
        (None, "Autovacuum configuration appears adequate"))),
}
AUTOVACUUM_EFFECT = Ladder(
    ("last_autovacuum IS NULL AND n_dead_tup > 10000", "AUTOVACUUM_NOT_RUNNING"),
    ("last_autovacuum < snap_ts - INTERVAL '7' DAY AND n_dead_tup > 0.2 * n_live_tup", "AUTOVACUUM_INSUFFICIENT"),
    ("n_dead_tup > 0.3 * n_live_tup", "NEEDS_TUNING"),
    default="OK",
)

def changes() -> Column:
    return F.expr(CHANGES)


def unanalyzed() -> Column:
    return F.expr(UNANALYZED)




def needs_vacuum(share: float = 0.1, floor: int = 1000) -> Column:
    return F.expr(f"n_dead_tup > greatest({share} * n_live_tup, {floor})")


def stale_and_changed() -> Column:
    return older_than(latest_of("last_analyze", "last_autoanalyze"), WEEK) & (changes() > 1000)


def needs_analyze() -> Column:
    return any_of(unanalyzed(), stale_and_changed(), F.expr(f"{CHANGES} > 0.1 * n_live_tup"))


def worth_analyzing() -> Column:
    return any_of(unanalyzed() & (F.col("n_live_tup") > 1000), stale_and_changed())


@report("MS1", order="name")
def autovacuum_settings(s: Snapshots) -> DataFrame:
    mine = F.col("name").like("autovacuum%") | F.col("name").isin("vacuum_cost_delay", "vacuum_cost_limit")
    return s.settings.where(mine).select(*SNAP, "name", "setting", "unit", "short_desc")


@report("MS2", order="dead_tuples desc")
def vacuum_candidates(s: Snapshots) -> DataFrame:
    return s.table_stats.where(needs_vacuum()).select(
        *SNAP, "schemaname", "table_name", F.col("n_dead_tup").alias("dead_tuples"), F.col("n_live_tup").alias("live_tuples"),
        dead_percent().alias("dead_tuple_percentage"), pretty_bytes("total_relation_size").alias("table_size"),
        "last_vacuum", "last_autovacuum", VACUUM_PRIORITY.column().alias("vacuum_priority"),
        VACUUM_PRIORITY.rank().alias("priority_rank"), TABLE_SIZE.column().alias("size_category"))


@report("MS3", order="total_modifications desc")
def analyze_candidates(s: Snapshots) -> DataFrame:
    newest = latest_of("last_analyze", "last_autoanalyze")
    days = F.call_function("div", F.unix_timestamp("snap_ts") - F.unix_timestamp(newest), F.lit(86400))
    return s.table_stats.where(needs_analyze()).select(
        *SNAP, "schemaname", "table_name", changes().alias("total_modifications"), F.col("n_live_tup").alias("live_tuples"),
        percent(changes(), "n_live_tup").alias("modification_percentage"), "last_analyze", "last_autoanalyze",
        F.greatest("last_analyze", "last_autoanalyze").alias("most_recent_analyze"), days.alias("days_since_analyze"),
        ANALYZE_PRIORITY.column().alias("analyze_priority"), ANALYZE_PRIORITY.rank().alias("priority_rank"))


@report("MS4", order="index_size_bytes desc")
def index_bloat(s: Snapshots, min_mb: int = 10) -> DataFrame:
    big = s.index_stats.where(F.col("index_size") > min_mb * MB).withColumn("bloat_status", BLOAT_STATUS.column())
    return big.where((F.col("bloat_status") != "NORMAL") | F.expr("idx_tup_read > 10 * idx_tup_fetch")).select(
        *SNAP, "schemaname", "table_name", "index_name", F.col("index_size").alias("index_size_bytes"),
        pretty_bytes("index_size").alias("index_size"), F.col("idx_scan").alias("times_used"), "bloat_status",
        REINDEX.column().alias("reindex_recommendation"))


@report("MS5")
def workload_estimate(s: Snapshots) -> DataFrame:
    vacuum, analyze = needs_vacuum(), needs_analyze()
    size = F.col("total_relation_size")
    totals = s.table_stats.groupBy(*SNAP).agg(
        F.count_if(vacuum).alias("tables_need_vacuum"),
        F.count_if(F.expr("n_dead_tup > 0.2 * n_live_tup")).alias("tables_urgent_vacuum"),
        F.count_if(analyze).alias("tables_need_analyze"),
        F.coalesce(F.sum(F.when(vacuum, size)), F.lit(0)).alias("vacuum_bytes"),
        F.coalesce(F.sum(F.when(analyze, size)), F.lit(0)).alias("analyze_bytes"))
    return totals.select(
        *SNAP, "tables_need_vacuum", "tables_urgent_vacuum", "tables_need_analyze", "vacuum_bytes", "analyze_bytes",
        pretty_bytes("vacuum_bytes").alias("vacuum_workload_size"), pretty_bytes("analyze_bytes").alias("analyze_workload_size"),
        URGENCY.column().alias("maintenance_urgency"))


@report("MS6", order="n_dead_tup desc")
def autovacuum_effectiveness(s: Snapshots, k: int = 20) -> DataFrame:
    dirty = s.table_stats.where(F.col("n_dead_tup") > 1000)
    return top_k(dirty, k, F.col("n_dead_tup").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, "schemaname", "table_name", "n_dead_tup", dead_percent().alias("dead_percentage"), "last_vacuum", "last_autovacuum",
        AUTOVACUUM_EFFECT.column().alias("autovacuum_effectiveness"), pretty_bytes("total_relation_size").alias("table_size"))


@report("MS7")
def maintenance_advice(s: Snapshots) -> DataFrame:
    counts = s.table_stats.groupBy(*SNAP).agg(
        F.count_if(needs_vacuum(0.2, 5000)).alias("urgent"), F.count_if(needs_vacuum()).alias("vacuum"),
        F.count_if(worth_analyzing()).alias("stale"))
    summary = counts.join(pivot_settings(s.settings, "autovacuum_max_workers", "autovacuum"), SNAP, "left").withColumn(
        "workers", as_number("autovacuum_max_workers"))
    return advice_rows(
        summary, "recommendation", {key: title for key, (title, _) in ADVICE.items()},
        **{key: sentence(rules) for key, (_, rules) in ADVICE.items()})


@report("MS8")
def vacuum_commands(s: Snapshots, k: int = 10) -> DataFrame:
    worst = top_k(s.table_stats.where(needs_vacuum(0.2, 5000)), k, F.col("n_dead_tup").desc_nulls_first(), F.col("relid").asc())
    return worst.select(*SNAP, F.format_string("VACUUM (VERBOSE, ANALYZE) %s;", qualified()).alias("vacuum_command"))


@report("MS9")
def analyze_commands(s: Snapshots, k: int = 10) -> DataFrame:
    worst = top_k(s.table_stats.where(worth_analyzing()), k, changes().desc_nulls_first(), F.col("relid").asc())
    return worst.select(*SNAP, F.format_string("ANALYZE (VERBOSE) %s;", qualified()).alias("analyze_command"))


def _chosen(schema: str | None, globs: str | None) -> Column:
    """Schema and table filters apply to every candidate, whatever made it one."""
    in_schema = F.col("schemaname") == schema if schema else ~F.col("schemaname").isin("information_schema", "pg_catalog")
    return in_schema & match_globs("table_name", globs)


@report("AM1", order="dead_ratio desc, table_size desc")
def plan_vacuum(s: Snapshots, dead_pct: float = 20, schema: str | None = None, globs: str | None = None,
                skip_larger_than: str | None = None) -> DataFrame:
    """Tables to vacuum. Large ones are marked as skipped only if a size is asked for."""
    dead = s.table_stats.where(_chosen(schema, globs)).withColumn("dead_ratio", dead_percent())
    size = F.col("total_relation_size")
    too_big = size > parse_bytes(F.lit(skip_larger_than)) if skip_larger_than else F.lit(False)
    return dead.where(F.col("dead_ratio") >= dead_pct).select(
        *SNAP, "schemaname", "table_name", "n_dead_tup", "n_live_tup", "dead_ratio", size.alias("table_size"),
        "last_vacuum", "last_autovacuum", too_big.alias("skipped_because_large"))


@report("AM2", order="total_changes desc")
def plan_analyze(s: Snapshots, schema: str | None = None, globs: str | None = None) -> DataFrame:
    return s.table_stats.where(needs_analyze() & _chosen(schema, globs)).select(
        *SNAP, "schemaname", "table_name", changes().alias("total_changes"), F.col("total_relation_size").alias("table_size"),
        "last_analyze", "last_autoanalyze", PLAN_PRIORITY.column().alias("analyze_priority"))


@report("AM3", order="phase, table_size desc")
def plan_auto(s: Snapshots, **options) -> DataFrame:
    """Analyze first, then vacuum, as one plan."""
    analyze_options = {k: v for k, v in options.items() if k in ("schema", "globs")}
    analyze = plan_analyze(s, **analyze_options).select(
        *SNAP, F.lit(1).alias("phase"), F.lit("ANALYZE").alias("action"), "schemaname", "table_name",
        F.col("analyze_priority").alias("reason"), "table_size")
    vacuum = plan_vacuum(s, **options).where(~F.col("skipped_because_large")).select(
        *SNAP, F.lit(2).alias("phase"), F.lit("VACUUM").alias("action"), "schemaname", "table_name",
        F.format_string("dead %.2f%%", "dead_ratio").alias("reason"), "table_size")
    return analyze.unionByName(vacuum)
