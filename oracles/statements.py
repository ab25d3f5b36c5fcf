from fleetstat.plans.statements import PERFORMANCE_CATEGORY, STATEMENT_TYPE
from oracles.sqltext import pct, quotient, r2, top

SNIP = "left(query, 120) || '...' AS query_snippet"
HIT = f"{pct('shared_blks_hit', '(shared_blks_hit + shared_blks_read)')} AS hit_percent"
MEAN = f"{r2('mean_exec_time')} AS mean_time_ms"

SQL = {
    "qp1_workload_overview": f"""
        SELECT server_id, count(*) AS total_queries, sum(calls)::BIGINT AS total_calls,
               {r2('sum(total_exec_time)')} AS total_exec_time_ms, {r2('avg(mean_exec_time)')} AS avg_mean_time_ms,
               {quotient('sum(total_exec_time::BIGINT)', 'sum(calls)')} AS overall_avg_time_ms,
               sum(rows)::BIGINT AS total_rows_returned
        FROM statements GROUP BY server_id""",
    "qp2_top_by_total_time": f"""
        SELECT server_id, queryid, calls, {r2('total_exec_time')} AS total_time_ms, {MEAN},
               {r2('stddev_exec_time')} AS stddev_time_ms, percent_total_time, rows, {HIT}, {SNIP}
        FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY total_exec_time DESC, queryid) AS rn,
                     {pct('total_exec_time::BIGINT', 'sum(total_exec_time::BIGINT) OVER (PARTITION BY server_id)')} AS percent_total_time
              FROM statements) x WHERE rn <= 20""",
    "qp3_slowest_by_mean": f"""
        SELECT server_id, queryid, calls, {MEAN}, {r2('max_exec_time')} AS max_time_ms, {r2('min_exec_time')} AS min_time_ms,
               {r2('stddev_exec_time')} AS stddev_time_ms, rows, {quotient('rows', 'greatest(calls, 1)')} AS avg_rows_per_call, {SNIP}
        FROM ({top('SELECT * FROM statements WHERE calls > 5', 20, 'mean_exec_time DESC, queryid')}) x""",
    "qp4_most_called": f"""
        SELECT server_id, queryid, calls, {r2('total_exec_time')} AS total_time_ms, {MEAN}, percent_total_calls, rows, {HIT}, {SNIP}
        FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY calls DESC, queryid) AS rn,
                     {pct('calls', 'sum(calls) OVER (PARTITION BY server_id)')} AS percent_total_calls
              FROM statements) x WHERE rn <= 20""",
    "qp5_poor_cache_hit": top(f"""
        SELECT server_id, queryid, calls, shared_blks_read, shared_blks_hit, {HIT}, {MEAN},
               shared_blks_read + shared_blks_hit AS total_blocks, {SNIP}
        FROM statements WHERE shared_blks_read + shared_blks_hit > 1000 AND shared_blks_read > 0""",
        20, "hit_percent NULLS LAST, total_blocks DESC, queryid"),
    "qp6_io_intensive": f"""
        SELECT server_id, queryid, calls, shared_blks_read, shared_blks_written, shared_blks_dirtied, local_blks_read,
               local_blks_written, temp_blks_read, temp_blks_written, {MEAN}, {SNIP}
        FROM ({top('''SELECT * FROM statements
              WHERE shared_blks_read + shared_blks_written + temp_blks_read + temp_blks_written > 10000''', 15,
              'shared_blks_read + shared_blks_written + temp_blks_read + temp_blks_written DESC, queryid')}) x""",
    "qp7_temp_spill": f"""
        SELECT server_id, queryid, calls, temp_blks_read, temp_blks_written,
               {quotient('temp_blks_written * 8192', '1048576')} AS temp_mb_written, {MEAN}, rows, {SNIP}
        FROM ({top('SELECT * FROM statements WHERE temp_blks_written > 0', 15, 'temp_blks_written DESC, queryid')}) x""",
    "qp8_high_variance": f"""
        SELECT server_id, queryid, calls, {MEAN}, {r2('stddev_exec_time')} AS stddev_time_ms, {r2('max_exec_time')} AS max_time_ms,
               {r2('min_exec_time')} AS min_time_ms, {r2('cv')} AS coefficient_of_variation, {SNIP}
        FROM ({top('''SELECT *, stddev_exec_time / greatest(mean_exec_time, 1.0) * 100 AS cv FROM statements
              WHERE calls > 10 AND stddev_exec_time > 0 AND mean_exec_time > 100''', 20, 'cv DESC, queryid')}) x""",
    "qp9_wal_heavy": f"""
        SELECT server_id, queryid, calls, wal_records, wal_fpi, wal_bytes, {quotient('wal_bytes', '1048576')} AS wal_mb,
               {quotient('wal_bytes', '(greatest(calls, 1) * 1024)')} AS avg_wal_kb_per_call, {MEAN}, {SNIP}
        FROM ({top('SELECT * FROM statements WHERE wal_bytes > 0', 15, 'wal_bytes DESC, queryid')}) x""",
    "qp10_jit_cost": f"""
        SELECT server_id, queryid, calls, jit_functions, jit_generation_time, jit_inlining_count, jit_inlining_time,
               jit_optimization_count, jit_optimization_time, jit_emission_count, jit_emission_time, {MEAN},
               left(query, 100) || '...' AS query_snippet
        FROM ({top('SELECT * FROM statements WHERE jit_functions > 0', 10,
              'jit_generation_time + jit_inlining_time + jit_optimization_time + jit_emission_time DESC, queryid')}) x""",
    "qp11_usage_by_statement_type": f"""
        SELECT server_id, {STATEMENT_TYPE.sql()} AS query_type, count(*) AS query_count, sum(calls)::BIGINT AS total_calls,
               {r2('sum(total_exec_time)')} AS total_time_ms,
               {r2('avg(total_exec_time / greatest(calls, 1))')} AS avg_time_per_call_ms,
               sum(shared_blks_read + shared_blks_hit)::BIGINT AS total_blocks_accessed,
               sum(shared_blks_written)::BIGINT AS total_blocks_written, sum(temp_blks_written)::BIGINT AS total_temp_blocks,
               {pct('sum(shared_blks_hit)', 'sum(shared_blks_hit + shared_blks_read)')} AS avg_hit_ratio
        FROM statements GROUP BY server_id, query_type""",
    "qp12_degradation_candidates": f"""
        SELECT server_id, queryid, calls, {MEAN}, {r2('stddev_exec_time')} AS stddev_time_ms, total_blocks,
               {PERFORMANCE_CATEGORY.sql()} AS performance_category, {SNIP}
        FROM ({top('''SELECT *, shared_blks_read + shared_blks_hit AS total_blocks FROM statements
              WHERE calls > 50 AND mean_exec_time > 100''', 25, PERFORMANCE_CATEGORY.rank_sql() + ', mean_exec_time DESC, queryid')}) x""",
}
