"""Missing, unused and duplicate indexes; update efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, Ladder, any_of, fillfactor_of, is_monitoring_query, normalise_parameters, percent, pretty_bytes, qualified,
    two_decimals, utc_text, whole_quotient,
)
from fleetstat.operators.joins import shuffled
from fleetstat.operators.ranking import top_k
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

MB = 1024**2

# Thresholds and labels of the index reports.
SCAN_PRIORITY = Ladder(
    ("seq_scan > 1000 AND seq_scan > 2 * coalesce(idx_scan, 0)", "HIGH PRIORITY: Frequent sequential scans"),
    ("seq_scan > 100 AND seq_tup_read > 10 * n_live_tup", "MEDIUM PRIORITY: Large sequential scans"),
    ("seq_scan > idx_scan AND n_live_tup > 10000", "LOW PRIORITY: Consider indexing for large table"),
    default="OK: Reasonable scan patterns",
)
INDEX_ASSESSMENT = Ladder(
    ("idx_scan = 0", "UNUSED: Consider dropping"), ("idx_scan < 10", "RARELY USED: Investigate"), default="ACTIVELY USED: Keep")
QUERY_PRIORITY = Ladder(
    ("mean_exec_time > 1000 AND calls > 100", "HIGH PRIORITY: Slow frequent query"),
    ("shared_blks_read > 1000 AND calls > 10", "MEDIUM PRIORITY: High I/O query"),
    ("calls > 1000", "LOW PRIORITY: Very frequent query"),
    default="MONITOR: Review query pattern",
)
PARTIAL_INDEX = Ladder(
    ("seq_scan > 100 AND seq_tup_read > 5 * n_live_tup", "Consider partial indexes for commonly filtered subsets"),
    (f"relation_size > {1024**3} AND seq_scan > 10", "Large table with sequential scans - investigate WHERE conditions"),
    default="Table scan patterns appear reasonable",
)
INDEX_SUMMARY = Ladder(
    ("unused_indexes > 5", "Consider removing unused indexes to improve write performance"),
    ("tables_needing_indexes > 5", "Several tables show high sequential scan activity"),
    default="Index usage patterns appear reasonable",
)
HOT_RISK = Ladder(("hot_update_percent < 30", "high"), ("hot_update_percent < 50", "medium"), default="info")
MISSING = "MISSING: No index found on foreign key column"
INDEX_KEY = [*SNAP, "schemaname", "table_name", "indkey"]
MIN_UPDATES, LOW_HOT, CRITICAL_HOT = 100, 50.0, 30.0


def foreign_keys_of(s: Snapshots) -> DataFrame:
    """Foreign keys with their own and referenced columns."""
    on = [*SNAP, "constraint_name", "table_schema"]
    keys = s.table_constraints.where(F.col("constraint_type") == "FOREIGN KEY").select(*on, "table_name")
    return (
        keys.join(shuffled(s.key_columns.select(*on, "column_name", "column_position")), on)
        .join(shuffled(s.constraint_columns.select(*on, "ref_table", "ref_column")), on))


@report("MI1")
def seq_scan_hotspots(s: Snapshots, min_live: int = 1000, k: int = 20) -> DataFrame:
    impact = F.col("seq_scan").cast("decimal(38,0)") * F.col("seq_tup_read")
    busy = s.table_stats.where(F.col("n_live_tup") > min_live).withColumn("_impact", impact)
    zero = F.lit(0)
    return top_k(busy, k, F.col("_impact").desc_nulls_first(), F.col("seq_scan").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), F.col("seq_scan").alias("sequential_scans"),
        F.col("seq_tup_read").alias("sequential_tuples_read"), F.col("idx_scan").alias("index_scans"),
        F.col("idx_tup_fetch").alias("index_tuples_fetched"), F.col("n_live_tup").alias("estimated_rows"),
        pretty_bytes("relation_size").alias("table_size"),
        F.coalesce(percent("seq_scan", F.col("seq_scan") + F.coalesce("idx_scan", zero)), F.lit(0.0)).alias("seq_scan_percentage"),
        F.coalesce(whole_quotient("seq_tup_read", "seq_scan"), zero).alias("avg_tuples_per_seq_scan"),
        SCAN_PRIORITY.column().alias("index_recommendation_priority"),
        F.format_string("ANALYZE %s; -- Check column distributions", qualified()).alias("suggested_analysis"))


@report("MI2")
def fk_missing_index(s: Snapshots) -> DataFrame:
    """Foreign key columns with the indexes whose definition mentions them, or a CREATE INDEX suggestion.

    The match inside the definition is a residual of an equality join on the
    table, so only the few indexes of the same table are ever compared.
    """
    fk = foreign_keys_of(s).alias("fk")
    idx = s.index_stats.select(*SNAP, "schemaname", "table_name", "index_name", "indexdef").alias("ix")
    same_table = (
        (F.col("fk.server_id") == F.col("ix.server_id")) & (F.col("fk.snap_ts") == F.col("ix.snap_ts"))
        & (F.col("fk.table_schema") == F.col("ix.schemaname")) & (F.col("fk.table_name") == F.col("ix.table_name")))
    found = fk.join(shuffled(idx), same_table & F.col("ix.indexdef").contains(F.col("fk.column_name")), "left").select("fk.*", "ix.index_name")
    rows = s.table_stats.select(
        *SNAP, F.col("schemaname").alias("table_schema"), "table_name", "n_live_tup", "relation_size")
    missing = F.col("index_name").isNull()
    full = qualified("table_schema", "table_name")
    return found.where(~F.col("table_schema").isin("information_schema", "pg_catalog")).join(
        shuffled(rows), [*SNAP, "table_schema", "table_name"], "left").select(
        *SNAP, full.alias("table_name"), F.col("column_name").alias("fk_column"), F.col("ref_table").alias("references_table"),
        F.col("ref_column").alias("references_column"),
        F.when(missing, MISSING).otherwise(F.concat(F.lit("EXISTS: "), "index_name")).alias("index_status"),
        F.when(missing, F.format_string(
            "CREATE INDEX CONCURRENTLY idx_%s_%s ON %s (%s);", "table_name", "column_name", full, "column_name"))
        .otherwise("-- Index already exists").alias("suggested_index_creation"),
        F.col("n_live_tup").alias("estimated_rows"), pretty_bytes("relation_size").alias("table_size"))


@report("MI3", order="times_used, index_size_bytes desc")
def unused_indexes(s: Snapshots, min_mb: int = 1) -> DataFrame:
    tables = s.table_stats.select(*SNAP, "relid", F.col("n_live_tup").alias("table_rows"), "relation_size")
    big = s.index_stats.where((F.col("index_size") > min_mb * MB) & ~F.col("schemaname").isin("information_schema", "pg_catalog"))
    drop = F.format_string("DROP INDEX CONCURRENTLY %s; -- Backup first!", qualified("schemaname", "index_name"))
    return big.join(shuffled(tables), [*SNAP, "relid"], "left").select(
        *SNAP, qualified().alias("table_name"), "index_name", F.col("index_size").alias("index_size_bytes"),
        pretty_bytes("index_size").alias("index_size"), F.col("idx_scan").alias("times_used"),
        pretty_bytes("relation_size").alias("table_size"), "table_rows", INDEX_ASSESSMENT.column().alias("usage_assessment"),
        F.when(F.col("idx_scan") == 0, drop).otherwise("-- Index is being used").alias("drop_suggestion"),
        F.col("indexdef").alias("index_definition"))


@report("MI4")
def query_index_candidates(s: Snapshots, k: int = 20) -> DataFrame:
    heavy = any_of(F.col("mean_exec_time") > 100, F.col("calls") > 100, F.col("shared_blks_read") > 100)
    picked = s.statements.where(~is_monitoring_query("query") & (F.col("calls") > 5) & heavy).withColumn(
        "_impact", F.col("calls") * F.col("mean_exec_time"))
    blocks = F.col("shared_blks_read") + F.col("shared_blks_hit")
    best = top_k(picked, k, F.col("_impact").desc_nulls_first(), F.col("calls").desc_nulls_first(), F.col("queryid").asc())
    return best.select(
        *SNAP, F.col("calls").alias("execution_count"), F.col("total_exec_time").alias("total_execution_time_ms"),
        two_decimals("mean_exec_time").alias("mean_execution_time_ms"), F.col("shared_blks_read").alias("blocks_read_from_disk"),
        F.col("shared_blks_hit").alias("blocks_read_from_cache"),
        F.coalesce(percent("shared_blks_hit", blocks), F.lit(0.0)).alias("cache_hit_ratio"),
        F.left("query", F.lit(200)).alias("query_sample"), QUERY_PRIORITY.column().alias("optimization_priority"),
        F.concat(F.lit("EXPLAIN (ANALYZE, BUFFERS) "), F.left(normalise_parameters("query"), F.lit(100)), F.lit("...")).alias("explain_suggestion"))


@report("MI5")
def partial_index_candidates(s: Snapshots, k: int = 15) -> DataFrame:
    impact = F.col("seq_scan").cast("decimal(38,0)") * F.col("seq_tup_read")
    scanned = s.table_stats.where((F.col("n_live_tup") > 10000) & (F.col("seq_scan") > 10)).withColumn("_impact", impact)
    return top_k(scanned, k, F.col("_impact").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), F.col("n_live_tup").alias("total_rows"),
        pretty_bytes("relation_size").alias("table_size"), F.col("seq_scan").alias("sequential_scans"),
        F.coalesce(whole_quotient("seq_tup_read", "seq_scan"), F.lit(0)).alias("avg_rows_per_seq_scan"),
        PARTIAL_INDEX.column().alias("partial_index_recommendation"),
        F.format_string("-- Example: CREATE INDEX CONCURRENTLY idx_%s_partial ON %s (column_name) WHERE condition;",
                        "table_name", qualified()).alias("partial_index_example"))


@report("MI6")
def index_summary(s: Snapshots) -> DataFrame:
    unused = F.col("idx_scan") == 0
    indexes = s.index_stats.groupBy(*SNAP).agg(
        F.count_if(unused).alias("unused_indexes"), F.sum(F.when(unused, F.col("index_size"))).alias("unused_index_bytes"))
    tables = s.table_stats.groupBy(*SNAP).agg(
        F.count_if((F.col("seq_scan") > F.col("idx_scan")) & (F.col("n_live_tup") > 1000)).alias("tables_needing_indexes"))
    return indexes.join(tables, SNAP, "full").select(
        *SNAP, "unused_indexes", "tables_needing_indexes", "unused_index_bytes",
        pretty_bytes("unused_index_bytes").alias("unused_index_size"), INDEX_SUMMARY.column().alias("primary_recommendation"))


@report("A9", order="table_name")
def duplicate_indexes(s: Snapshots) -> DataFrame:
    """Indexes of one table over the same columns: how many, the first name and the bytes. ``A9L`` has every member."""
    return s.index_stats.groupBy(*INDEX_KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.min("index_name").alias("first_index"), F.sum("index_size").alias("total_bytes")).where("copies > 1")


@report("A9L", order="table_name, index_name")
def duplicate_index_members(s: Snapshots) -> DataFrame:
    """Every index that has a duplicate, in long form and complete for groups of any size."""
    groups = s.index_stats.groupBy(*INDEX_KEY).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return s.index_stats.select(*INDEX_KEY, "index_name", "index_size").join(groups, INDEX_KEY)


# --- update efficiency -----------------------------------------------------------

def _hot(s: Snapshots) -> DataFrame:
    updated = s.table_stats.where(F.col("n_tup_upd") > MIN_UPDATES)
    return updated.withColumn("_ratio", F.col("n_tup_hot_upd").cast("double") / F.col("n_tup_upd").cast("double"))


def _worst_hot(s: Snapshots, k: int) -> DataFrame:
    return top_k(_hot(s), k, F.col("_ratio").asc_nulls_last(), F.col("n_tup_upd").desc_nulls_first(), F.col("relid").asc())


@report("HU1", order="hot_update_percent, total_updates desc")
def hot_update_efficiency(s: Snapshots, k: int = 50) -> DataFrame:
    return _worst_hot(s, k).select(
        *SNAP, qualified().alias("table_name"), F.col("n_tup_upd").alias("total_updates"),
        F.col("n_tup_hot_upd").alias("hot_updates"), F.col("n_live_tup").alias("live_tuples"),
        F.col("n_dead_tup").alias("dead_tuples"), percent("n_tup_hot_upd", "n_tup_upd").alias("hot_update_percent"),
        (F.col("n_tup_upd") - F.col("n_tup_hot_upd")).alias("non_hot_updates"),
        pretty_bytes("relation_size").alias("table_size"), (F.col("seq_scan") + F.col("idx_scan")).alias("total_scans"))


@report("HU2")
def fillfactor_candidates(s: Snapshots, max_ratio: float = 0.5, k: int = 20) -> DataFrame:
    low = _hot(s).where(F.col("_ratio") < max_ratio)
    return top_k(low, k, F.col("n_tup_upd").desc_nulls_first(), F.col("relid").asc()).select(
        *SNAP, qualified().alias("table_name"), percent("n_tup_hot_upd", "n_tup_upd").alias("hot_update_percent"),
        F.format_string("ALTER TABLE %s SET (fillfactor = 90);", qualified()).alias("suggested_command"))


# Page, header and tuple sizes of a B-tree index, and how full its pages are built.
PAGE, PAGE_OVERHEAD, LEAF_FILL, TUPLE_OVERHEAD, ALIGNED, UNKNOWN_WIDTH = 8192, 40, 90, 12, 8, 8


def index_sizes(s: Snapshots) -> DataFrame:
    """What each index holds against the pages it should need for its table's rows and its key's average width.

    A key column without statistics, or an expression, counts as eight bytes.
    """
    key = [*SNAP, "relid", "index_name"]
    columns = s.index_stats.select(
        *key, F.explode(F.split(F.regexp_extract("indexdef", r"\((.*)\)", 1), ", ")).alias("attname"))
    widths = s.column_stats.select(*SNAP, "relid", "attname", "avg_width")
    aligned = F.call_function("div", F.coalesce("avg_width", F.lit(UNKNOWN_WIDTH)) + ALIGNED - 1, F.lit(ALIGNED)) * ALIGNED
    keys = columns.join(shuffled(widths), [*SNAP, "relid", "attname"], "left").groupBy(*key).agg(F.sum(aligned).alias("key_width"))
    rows = s.table_stats.select(*SNAP, "relid", F.col("n_live_tup").alias("row_count"))
    per_page = F.greatest(F.lit(1), F.call_function("div", F.lit((PAGE - PAGE_OVERHEAD) * LEAF_FILL // 100), F.col("key_width") + TUPLE_OVERHEAD))
    pages = F.call_function("div", F.col("row_count") + per_page - 1, per_page) + 1
    return (
        s.index_stats.select(*key, "schemaname", "table_name", "index_size").join(shuffled(keys), key).join(shuffled(rows), [*SNAP, "relid"])
        .withColumn("expected_bytes", pages * PAGE)
        .withColumn("bloat_bytes", F.greatest(F.lit(0), F.col("index_size") - F.col("expected_bytes")))
        .withColumn("bloat_percent", percent("bloat_bytes", "index_size")))


@report("IB1", order="bloat_bytes desc, index_name")
def index_bloat(s: Snapshots) -> DataFrame:
    """Estimated bloat of every index."""
    return index_sizes(s).select(
        *SNAP, "schemaname", "table_name", "index_name", "row_count", "key_width", "index_size", "expected_bytes", "bloat_bytes",
        "bloat_percent", pretty_bytes("bloat_bytes").alias("bloat_size"))


def hot_update_documents(s: Snapshots, k: int = 50) -> DataFrame:
    """One nested document per snapshot; at most k tables each, so the arrays are bounded."""
    ranked = _worst_hot(s, k).withColumn("hot_update_percent", percent("n_tup_hot_upd", "n_tup_upd"))
    target = F.when(F.col("hot_update_percent") < CRITICAL_HOT, 80).when(F.col("hot_update_percent") < LOW_HOT, 90)
    fields = ranked.select(
        *SNAP, "_ratio", "relid", "n_tup_upd", qualified().alias("table_name"), "hot_update_percent",
        fillfactor_of("reloptions").alias("current_fillfactor"), target.alias("recommended_fillfactor"),
        HOT_RISK.column().alias("risk_level"), "n_tup_hot_upd", "n_live_tup", "n_dead_tup", "relation_size", "seq_scan", "idx_scan")
    command = F.format_string("ALTER TABLE %s SET (fillfactor = %d);", "table_name", "recommended_fillfactor")
    rank = [F.col("_ratio"), (-F.col("n_tup_upd")).alias("_neg"), F.col("relid")]
    table = F.struct(
        "table_name", F.col("n_tup_upd").alias("total_updates"), F.col("n_tup_hot_upd").alias("hot_updates"),
        F.col("n_live_tup").alias("live_tuples"), F.col("n_dead_tup").alias("dead_tuples"), "hot_update_percent",
        (F.col("n_tup_upd") - F.col("n_tup_hot_upd")).alias("non_hot_updates"), "current_fillfactor",
        F.col("relation_size").alias("table_size_bytes"), pretty_bytes("relation_size").alias("table_size"),
        (F.col("seq_scan") + F.col("idx_scan")).alias("total_scans"), "risk_level", "recommended_fillfactor",
        utc_text("snap_ts").alias("collected_at"))
    advice = F.struct(
        "table_name", F.lit("Low HOT update percentage").alias("issue"), command.alias("action"), "hot_update_percent",
        "current_fillfactor", "recommended_fillfactor", command.alias("suggested_command"))
    gathered = fields.groupBy(*SNAP).agg(
        F.sort_array(F.collect_list(F.struct(*rank, table.alias("doc")))).alias("_t"),
        F.sort_array(F.collect_list(F.when(F.col("hot_update_percent") < LOW_HOT, F.struct(*rank, advice.alias("doc"))))).alias("_r"))
    return gathered.select(
        *SNAP, utc_text("snap_ts").alias("extracted_at"),
        F.struct(F.lit(MIN_UPDATES).alias("minimum_updates"), F.lit(LOW_HOT).alias("low_hot_percent"),
                 F.lit(CRITICAL_HOT).alias("critical_hot_percent")).alias("thresholds"),
        F.transform("_t", lambda x: x["doc"]).alias("tables"), F.transform("_r", lambda x: x["doc"]).alias("recommendations"))


@report("HU3")
def hot_update_document(s: Snapshots, k: int = 50) -> DataFrame:
    """The document as JSON text with its main contents beside it."""
    docs = hot_update_documents(s, k)
    body = F.to_json(F.struct(
        F.col("server_id").cast("string").alias("database"), "extracted_at", "thresholds", "tables", "recommendations"))
    reparsed = "array<struct<table_name:string,recommended_fillfactor:int,risk_level:string>>"
    tables = F.from_json(F.get_json_object("body", "$.tables"), reparsed)
    return docs.select(*SNAP, body.alias("body")).select(
        *SNAP, F.get_json_object("body", "$.extracted_at").alias("extracted_at"),
        F.get_json_object("body", "$.thresholds.minimum_updates").cast("bigint").alias("minimum_updates"),
        F.size(tables).cast("bigint").alias("table_count"),
        F.array_join(F.transform(tables, lambda t: F.concat_ws(
            ":", t["table_name"], t["risk_level"], t["recommended_fillfactor"].cast("string"))), " ").alias("tables_in_order"),
        F.size(F.from_json(F.get_json_object("body", "$.recommendations"), reparsed)).cast("bigint").alias("recommendation_count"))
