"""Quality and freshness of planner statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, n_rows, Ladder, age_micros, array_length, as_number, latest_of, older_than, percent, pretty_bytes,
)
from fleetstat.operators import distribution
from fleetstat.operators.joins import pivot_settings
from fleetstat.operators.profile import column_profile
from fleetstat.plans.registry import report
from fleetstat.plans.resources import advice_rows, sentence
from fleetstat.sources.snapshots import Snapshots

HOUR = 3600 * 1_000_000

# Settings shown, thresholds and labels.
STATISTICS_SETTINGS = (
    "default_statistics_target", "track_activities", "track_counts", "track_io_timing", "track_functions")
WEAK_MCV = "n_distinct > 100 AND mcv_count < 10"
WEAK_HISTOGRAM = "n_distinct > 1000 AND histogram_buckets < 20"
WEAK_CORRELATION = "abs(correlation) > 0.1 AND histogram_buckets < 50"
STATISTICS_QUALITY = Ladder(
    (WEAK_MCV, "LOW_MCV_COUNT"),
    (WEAK_HISTOGRAM, "LOW_HISTOGRAM_RESOLUTION"),
    (WEAK_CORRELATION, "POOR_CORRELATION_STATS"),
    default="OK",
)
STATISTICS_AGE = Ladder(
    ("last_analyze IS NULL AND last_autoanalyze IS NULL", "NEVER"),
    ("most_recent_analyze < snap_ts - INTERVAL '30' DAY", "VERY_STALE"),
    ("most_recent_analyze < snap_ts - INTERVAL '7' DAY", "STALE"),
    ("most_recent_analyze < snap_ts - INTERVAL '1' DAY", "MODERATE"),
    default="FRESH",
)
NULL_CATEGORY = Ladder(
    ("null_frac > 0.5", "HIGH_NULLS"), ("null_frac > 0.1", "MODERATE_NULLS"), ("null_frac > 0", "LOW_NULLS"),
    default="NO_NULLS",
)
CARDINALITY_CATEGORY = Ladder(
    ("n_distinct = -1", "UNIQUE"), ("n_distinct > 1000", "HIGH_CARDINALITY"), ("n_distinct > 100", "MODERATE_CARDINALITY"),
    ("n_distinct > 10", "LOW_CARDINALITY"),
    default="VERY_LOW_CARDINALITY",
)
SIZE_CATEGORY = Ladder(("avg_width > 1000", "LARGE_VALUES"), ("avg_width > 100", "MEDIUM_VALUES"), default="SMALL_VALUES")
NOTABLE = "null_frac > 0.5 OR n_distinct = -1 OR n_distinct > 1000 OR avg_width > 100"
USAGE_CATEGORY = Ladder(
    ("idx_scan = 0", "UNUSED"), ("idx_scan < 10", "RARELY_USED"), ("idx_scan < 1000", "MODERATELY_USED"),
    default="FREQUENTLY_USED",
)
EFFICIENCY = Ladder(
    ("idx_scan > 0 AND idx_tup_read > 10 * idx_tup_fetch", "INEFFICIENT"),
    ("idx_scan > 0 AND idx_tup_read > 2 * idx_tup_fetch", "MODERATE_EFFICIENCY"),
    ("idx_scan > 0", "EFFICIENT"),
    default="NOT_EVALUATED",
)
ISSUES = [
    ("hours_since_analyze > 168 AND row_count > 100000", "STALE_STATS_LARGE_TABLE", "Run ANALYZE on this large table"),
    ("high_cardinality_low_mcv > 0", "INSUFFICIENT_MCV_STATS",
     "Consider increasing statistics_target for high cardinality columns"),
    ("high_correlation_columns > 0.5 * total_columns", "HIGH_CORRELATION_CONCERN",
     "Review column correlations and consider column statistics"),
    ("high_null_columns > 0.3 * total_columns", "HIGH_NULL_IMPACT", "High NULL percentage may affect query plans"),
]
ISSUE_TYPE = Ladder(*[(p, label) for p, label, _ in ISSUES], default="OK")
ISSUE_ADVICE = Ladder(*[(p, text) for p, _, text in ISSUES], default="Statistics appear adequate")
# Advice sentences and when they hold.
ADVICE = {
    "immediate": (
        ("never > 0", "ANALYZE {never} tables that have never been analyzed"),
        (None, "All tables have been analyzed at least once")),
    "regular": (
        ("stale > 0", "Update statistics on {stale} large tables with stale statistics"),
        (None, "Large table statistics are current")),
    "tuning": (
        ("weak > 0", "Consider increasing statistics_target for {weak} high-cardinality columns"),
        (None, "Column statistics targets appear adequate")),
    "configuration": (
        ("target < 100", "Consider increasing default_statistics_target (current: {target}, recommend: 100-1000)"),
        ("target > 1000", "default_statistics_target is high ({target}) - ensure ANALYZE performance is acceptable"),
        (None, "default_statistics_target ({target}) appears reasonable")),
}
ADVICE_TITLES = {
    "immediate": "IMMEDIATE STATISTICS ACTIONS:", "regular": "REGULAR STATISTICS MAINTENANCE:",
    "tuning": "STATISTICS TARGET TUNING:", "configuration": "CONFIGURATION RECOMMENDATION:",
}
STATISTICS_KIND = Ladder.lookup("first_kind", {
    "d": "n-distinct", "f": "functional dependencies", "m": "most common values"}, "unknown")


def hours_since(*stamps: str) -> Column:
    """Total whole hours (not the hour-of-day field of an interval)."""
    return F.call_function("div", age_micros(latest_of(*stamps)), F.lit(HOUR))


def user_columns(s: Snapshots) -> DataFrame:
    return s.column_stats.where(~F.col("schemaname").isin("information_schema", "pg_catalog")).select(
        "*", array_length("most_common_vals").alias("mcv_count"), array_length("histogram_bounds").alias("histogram_buckets"))


@report("SC1", order="name")
def statistics_settings(s: Snapshots) -> DataFrame:
    return s.settings.where(F.col("name").isin(*STATISTICS_SETTINGS)).select(*SNAP, "name", "setting", "unit", "short_desc")


@report("SC2", order="schemaname, table_name, column_name")
def custom_targets(s: Snapshots) -> DataFrame:
    target = F.col("attstattarget")
    return user_columns(s).where(target != -1).select(
        *SNAP, "schemaname", "table_name", F.col("attname").alias("column_name"), target.alias("statistics_target"),
        F.when(target == 0, F.lit("No statistics")).otherwise(target.cast("string")).alias("target_description"))


@report("SC3")
def insufficient_stats(s: Snapshots) -> DataFrame:
    weak = user_columns(s).where(F.expr(f"({WEAK_MCV}) OR ({WEAK_HISTOGRAM}) OR ({WEAK_CORRELATION})"))
    target = pivot_settings(s.settings, "default_statistics_target")
    return weak.join(target, SNAP, "left").select(
        *SNAP, "schemaname", "table_name", F.col("attname").alias("column_name"), "n_distinct", "most_common_vals",
        "mcv_count", "histogram_buckets", "correlation", STATISTICS_QUALITY.column().alias("statistics_quality"),
        F.col("default_statistics_target").alias("default_target"))


@report("SC4")
def stats_freshness(s: Snapshots, min_live: int = 1000) -> DataFrame:
    changes = F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")
    return s.table_stats.where(F.col("n_live_tup") > min_live).withColumn(
        "most_recent_analyze", F.greatest("last_analyze", "last_autoanalyze")
    ).select(
        *SNAP, "schemaname", "table_name", "n_live_tup", "n_dead_tup", changes.alias("total_changes_since_analyze"),
        "last_analyze", "last_autoanalyze", "most_recent_analyze",
        hours_since("last_analyze", "last_autoanalyze").alias("hours_since_analyze"),
        STATISTICS_AGE.column().alias("statistics_age"), percent(changes, "n_live_tup").alias("change_percentage"))


@report("SC5", order="schemaname, table_name, attname")
def column_distribution(s: Snapshots) -> DataFrame:
    return user_columns(s).where(NOTABLE).select(
        *SNAP, "schemaname", "table_name", "attname", "null_frac", "n_distinct", "avg_width",
        NULL_CATEGORY.column().alias("null_category"), CARDINALITY_CATEGORY.column().alias("cardinality_category"),
        SIZE_CATEGORY.column().alias("size_category"))


@report("SC6")
def index_efficiency(s: Snapshots, min_mb: int = 1) -> DataFrame:
    return s.index_stats.where(F.col("index_size") > min_mb * 1024**2).select(
        *SNAP, "schemaname", "table_name", "index_name", F.col("idx_scan").alias("scans"),
        F.col("idx_tup_read").alias("tuples_read"), F.col("idx_tup_fetch").alias("tuples_fetched"),
        pretty_bytes("index_size").alias("index_size"), USAGE_CATEGORY.column().alias("usage_category"),
        EFFICIENCY.column().alias("efficiency_rating"))


@report("SC7")
def table_stats_issues(s: Snapshots) -> DataFrame:
    per_table = user_columns(s).groupBy(*SNAP, "schemaname", "table_name").agg(
        F.count_if(F.expr("n_distinct > 1000 AND mcv_count < 10")).alias("high_cardinality_low_mcv"),
        F.count_if(F.col("null_frac") > 0.3).alias("high_null_columns"),
        F.count_if(F.abs("correlation") > 0.5).alias("high_correlation_columns"),
        n_rows().alias("total_columns"))
    tables = s.table_stats.select(
        *SNAP, "schemaname", "table_name", F.col("n_live_tup").alias("row_count"),
        hours_since("last_analyze", "last_autoanalyze").alias("hours_since_analyze"))
    joined = per_table.join(tables, [*SNAP, "schemaname", "table_name"], "left")
    return joined.withColumn("issue_type", ISSUE_TYPE.column()).where(F.col("issue_type") != "OK").withColumn(
        "recommendation", ISSUE_ADVICE.column())


@report("SC8", order="schema_name, table_name, statistics_name")
def extended_stats(s: Snapshots) -> DataFrame:
    sizes = s.table_stats.select(*SNAP, "relid", "total_relation_size")
    own = s.ext_stats.where(~F.col("schemaname").isin("information_schema", "pg_catalog")).withColumn(
        "first_kind", F.get("stxkind", F.lit(0)))
    return own.join(sizes, [*SNAP, "relid"], "left").select(
        *SNAP, F.col("schemaname").alias("schema_name"), "table_name", F.col("stxname").alias("statistics_name"),
        F.array_join(F.col("stxkeys").cast("array<string>"), ",").alias("column_positions"),
        STATISTICS_KIND.column().alias("statistics_type"), pretty_bytes("total_relation_size").alias("table_size"))


@report("SC9")
def statistics_advice(s: Snapshots) -> DataFrame:
    latest = latest_of("last_analyze", "last_autoanalyze")
    tables = s.table_stats.groupBy(*SNAP).agg(
        F.count_if(older_than(latest, 7 * 86400) & (F.col("n_live_tup") > 10000)).alias("stale"),
        F.count_if(F.col("last_analyze").isNull() & F.col("last_autoanalyze").isNull() & (F.col("n_live_tup") > 1000)).alias("never"))
    columns = user_columns(s).groupBy(*SNAP).agg(F.count_if(F.expr("n_distinct > 1000 AND mcv_count < 10")).alias("weak"))
    target = pivot_settings(s.settings, "default_statistics_target").select(
        *SNAP, as_number("default_statistics_target").alias("target"))
    summary = tables.join(columns, SNAP, "left").join(target, SNAP, "left").fillna(0, ["weak"])
    return advice_rows(summary, "recommendation", ADVICE_TITLES, **{key: sentence(rules) for key, rules in ADVICE.items()})


# --- statistics computed from data ---------------------------------------------

def _profile(table: str):
    def build(s: Snapshots, exact: bool = True) -> DataFrame:
        return column_profile(getattr(s, table), table, exact=exact)
    build.__name__ = "column_profile"
    return build


for _table in ("orders", "lineitem", "customer", "part", "events", "documents"):
    report(f"A16_{_table.upper()}")(_profile(_table))


#: Text columns that hold JSON objects, and the order in which a table's rows were stored.
JSON_COLUMNS = {"events": ("props",)}
ROW_ORDER = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"]}
COMMON_OF = ("orders", "lineitem", "customer", "part", "events", "documents", "embeddings")
NESTED_OF = ("events", "embeddings")


def _named(build, name: str):
    build.__name__ = name
    return build


def _common(table: str):
    return _named(lambda s, k=distribution.COMMON: distribution.most_common_values(
        getattr(s, table), table, k, json=JSON_COLUMNS.get(table, ())), "most_common_values")


def _bounds(table: str):
    return _named(lambda s, buckets=distribution.BUCKETS: distribution.histogram_bounds(getattr(s, table), table, buckets), "histogram_bounds")


def _correlation(table: str):
    return _named(lambda s: distribution.order_correlation(getattr(s, table), table, ROW_ORDER[table]), "order_correlation")


def _nested(table: str):
    return _named(lambda s: distribution.nested_profile(getattr(s, table), table, JSON_COLUMNS.get(table, ())), "nested_profile")


for _table in COMMON_OF:
    report(f"A16M_{_table.upper()}")(_common(_table))
for _table in ROW_ORDER:
    report(f"A16H_{_table.upper()}")(_bounds(_table))
    report(f"A16C_{_table.upper()}")(_correlation(_table))
for _table in NESTED_OF:
    report(f"A16N_{_table.upper()}")(_nested(_table))


def computed_statistics(s: Snapshots, tables=("orders", "customer"), target: int = 100) -> DataFrame:
    """Statistics of the tables' own columns, as a planner would have gathered them."""
    parts = [distribution.statistics(getattr(s, t), t, column_profile(getattr(s, t), t, exact=True), ROW_ORDER[t], target) for t in tables]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@report("SC3C")
def insufficient_computed_stats(s: Snapshots, target: int = 100) -> DataFrame:
    weak = computed_statistics(s, target=target).where(F.expr(f"({WEAK_MCV}) OR ({WEAK_HISTOGRAM}) OR ({WEAK_CORRELATION})"))
    return weak.select(
        "table_name", F.col("attname").alias("column_name"), "n_distinct", "mcv_count", "histogram_buckets", "correlation",
        STATISTICS_QUALITY.column().alias("statistics_quality"))


@report("SC5C")
def computed_distribution(s: Snapshots, tables=("orders", "lineitem", "customer", "part", "events", "documents")) -> DataFrame:
    parts = [column_profile(getattr(s, t), t, exact=True) for t in tables]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where(NOTABLE).select(
        "table_name", "attname", "null_frac", "n_distinct", "avg_width", NULL_CATEGORY.column().alias("null_category"),
        CARDINALITY_CATEGORY.column().alias("cardinality_category"), SIZE_CATEGORY.column().alias("size_category"))
