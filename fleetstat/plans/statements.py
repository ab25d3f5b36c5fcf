"""Query performance reports over ``statements``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import (
    SNAP, Ladder, coefficient_of_variation, micro_units, percent, ratio, snippet, two_decimals,
)
from fleetstat.operators.ranking import top_k, with_total
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

BLOCK = 8192

# Statement types by leading keyword.
STATEMENT_TYPE = Ladder(
    *[(f"query ILIKE '{word}%'", word) for word in ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER")],
    default="OTHER",
)

# Performance categories.
PERFORMANCE_CATEGORY = Ladder(
    ("stddev_exec_time > 2 * mean_exec_time", "HIGH_VARIANCE"),
    ("mean_exec_time > 5000", "VERY_SLOW"),
    ("mean_exec_time > 1000 AND total_blocks > 50000", "IO_BOUND"),
    ("mean_exec_time > 1000", "SLOW"),
    default="NORMAL",
)

def hit_percent() -> Column:
    return percent("shared_blks_hit", F.col("shared_blks_hit") + F.col("shared_blks_read")).alias("hit_percent")


def query_snippet() -> Column:
    return snippet("query").alias("query_snippet")


def mean_time() -> Column:
    return two_decimals("mean_exec_time").alias("mean_time_ms")




def _desc(*names: str):
    return [F.col(n).desc_nulls_first() for n in names] + [F.col("queryid").asc_nulls_last()]


@report("QP1")
def workload_overview(s: Snapshots) -> DataFrame:
    return s.statements.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum("calls").alias("total_calls"),
        two_decimals(F.sum("total_exec_time")).alias("total_exec_time_ms"),
        two_decimals(F.avg("mean_exec_time")).alias("avg_mean_time_ms"),
        ratio(F.sum(micro_units("total_exec_time")), F.sum("calls") * 1000).alias("overall_avg_time_ms"),
        F.sum("rows").alias("total_rows_returned"),
    )


@report("QP2", order="total_time_ms desc, queryid")
def top_by_total_time(s: Snapshots, k: int = 20) -> DataFrame:
    # Rank first: the share of the total is then worked out for k rows per snapshot only.
    best = top_k(s.statements, k, *_desc("total_exec_time"))
    shared = with_total(best, s.statements, _total=F.sum(micro_units("total_exec_time")))
    return shared.select(
        *SNAP, "queryid", "calls",
        two_decimals("total_exec_time").alias("total_time_ms"), mean_time(),
        two_decimals("stddev_exec_time").alias("stddev_time_ms"),
        percent(micro_units("total_exec_time"), "_total").alias("percent_total_time"),
        "rows", hit_percent(), query_snippet(),
    )


@report("QP3", order="mean_time_ms desc, queryid")
def slowest_by_mean(s: Snapshots, min_calls: int = 5, k: int = 20) -> DataFrame:
    return top_k(s.statements.where(F.col("calls") > min_calls), k, *_desc("mean_exec_time")).select(
        *SNAP, "queryid", "calls", mean_time(),
        two_decimals("max_exec_time").alias("max_time_ms"),
        two_decimals("min_exec_time").alias("min_time_ms"),
        two_decimals("stddev_exec_time").alias("stddev_time_ms"),
        "rows", ratio("rows", F.greatest("calls", F.lit(1))).alias("avg_rows_per_call"), query_snippet(),
    )


@report("QP4", order="calls desc, queryid")
def most_called(s: Snapshots, k: int = 20) -> DataFrame:
    best = top_k(s.statements, k, *_desc("calls"))
    return with_total(best, s.statements, _total=F.sum("calls")).select(
        *SNAP, "queryid", "calls",
        two_decimals("total_exec_time").alias("total_time_ms"), mean_time(),
        percent("calls", "_total").alias("percent_total_calls"),
        "rows", hit_percent(), query_snippet(),
    )


@report("QP5", order="hit_percent, total_blocks desc, queryid")
def poor_cache_hit(s: Snapshots, min_blocks: int = 1000, k: int = 20) -> DataFrame:
    blocks = s.statements.withColumn("total_blocks", F.col("shared_blks_read") + F.col("shared_blks_hit"))
    busy = blocks.where((F.col("total_blocks") > min_blocks) & (F.col("shared_blks_read") > 0))
    ranked = busy.withColumn("hit_percent", hit_percent())
    return top_k(ranked, k, F.col("hit_percent").asc_nulls_last(), *_desc("total_blocks")).select(
        *SNAP, "queryid", "calls", "shared_blks_read", "shared_blks_hit", "hit_percent", mean_time(),
        "total_blocks", query_snippet(),
    )


@report("QP6")
def io_intensive(s: Snapshots, min_blocks: int = 10_000, k: int = 15) -> DataFrame:
    moved = sum(
        (F.col(c) for c in ("shared_blks_read", "shared_blks_written", "temp_blks_read", "temp_blks_written")), F.lit(0))
    busy = s.statements.withColumn("_moved", moved).where(F.col("_moved") > min_blocks)
    return top_k(busy, k, *_desc("_moved")).select(
        *SNAP, "queryid", "calls", "shared_blks_read", "shared_blks_written", "shared_blks_dirtied",
        "local_blks_read", "local_blks_written", "temp_blks_read", "temp_blks_written", mean_time(), query_snippet(),
    )


@report("QP7", order="temp_blks_written desc, queryid")
def temp_spill(s: Snapshots, k: int = 15) -> DataFrame:
    return top_k(s.statements.where(F.col("temp_blks_written") > 0), k, *_desc("temp_blks_written")).select(
        *SNAP, "queryid", "calls", "temp_blks_read", "temp_blks_written",
        ratio(F.col("temp_blks_written") * BLOCK, F.lit(1024**2)).alias("temp_mb_written"),
        mean_time(), "rows", query_snippet(),
    )


@report("QP8", order="coefficient_of_variation desc, queryid")
def high_variance(s: Snapshots, min_calls: int = 10, min_mean: float = 100, k: int = 20) -> DataFrame:
    noisy = s.statements.where(
        (F.col("calls") > min_calls) & (F.col("stddev_exec_time") > 0) & (F.col("mean_exec_time") > min_mean)
    ).withColumn("_cv", coefficient_of_variation("stddev_exec_time", "mean_exec_time"))
    return top_k(noisy, k, *_desc("_cv")).select(
        *SNAP, "queryid", "calls", mean_time(),
        two_decimals("stddev_exec_time").alias("stddev_time_ms"),
        two_decimals("max_exec_time").alias("max_time_ms"),
        two_decimals("min_exec_time").alias("min_time_ms"),
        two_decimals("_cv").alias("coefficient_of_variation"), query_snippet(),
    )


@report("QP9", order="wal_bytes desc, queryid")
def wal_heavy(s: Snapshots, k: int = 15) -> DataFrame:
    return top_k(s.statements.where(F.col("wal_bytes") > 0), k, *_desc("wal_bytes")).select(
        *SNAP, "queryid", "calls", "wal_records", "wal_fpi", "wal_bytes",
        ratio("wal_bytes", F.lit(1024**2)).alias("wal_mb"),
        ratio("wal_bytes", F.greatest("calls", F.lit(1)) * 1024).alias("avg_wal_kb_per_call"),
        mean_time(), query_snippet(),
    )


@report("QP10")
def jit_cost(s: Snapshots, k: int = 10) -> DataFrame:
    """Empty where the server does not report compilation counters (they arrive as NULL)."""
    spent = sum((F.col(f"jit_{step}_time") for step in ("generation", "inlining", "optimization", "emission")), F.lit(0))
    compiled = s.statements.where(F.col("jit_functions") > 0).withColumn("_spent", spent)
    return top_k(compiled, k, *_desc("_spent")).select(
        *SNAP, "queryid", "calls", "jit_functions", "jit_generation_time", "jit_inlining_count", "jit_inlining_time",
        "jit_optimization_count", "jit_optimization_time", "jit_emission_count", "jit_emission_time",
        mean_time(), snippet("query", 100).alias("query_snippet"),
    )


@report("QP11", order="total_time_ms desc")
def usage_by_statement_type(s: Snapshots) -> DataFrame:
    accessed = F.sum(F.col("shared_blks_read") + F.col("shared_blks_hit"))
    per_call = F.col("total_exec_time") / F.greatest("calls", F.lit(1))
    return s.statements.groupBy(*SNAP, STATEMENT_TYPE.column().alias("query_type")).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.sum("calls").alias("total_calls"),
        two_decimals(F.sum("total_exec_time")).alias("total_time_ms"),
        two_decimals(F.avg(per_call)).alias("avg_time_per_call_ms"),
        accessed.alias("total_blocks_accessed"),
        F.sum("shared_blks_written").alias("total_blocks_written"),
        F.sum("temp_blks_written").alias("total_temp_blocks"),
        percent(F.sum("shared_blks_hit"), accessed).alias("avg_hit_ratio"),
    )


@report("QP12")
def degradation_candidates(s: Snapshots, min_calls: int = 50, min_mean: float = 100, k: int = 25) -> DataFrame:
    slow = s.statements.where((F.col("calls") > min_calls) & (F.col("mean_exec_time") > min_mean)).withColumn(
        "total_blocks", F.col("shared_blks_read") + F.col("shared_blks_hit"))
    ranked = slow.withColumn("_rank", PERFORMANCE_CATEGORY.rank())
    return top_k(ranked, k, F.col("_rank").asc_nulls_last(), *_desc("mean_exec_time")).select(
        *SNAP, "queryid", "calls", mean_time(),
        two_decimals("stddev_exec_time").alias("stddev_time_ms"), "total_blocks",
        PERFORMANCE_CATEGORY.column().alias("performance_category"), query_snippet(),
    )
