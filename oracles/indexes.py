from fleetstat.plans import indexes as I
from oracles.resources import FULL
from oracles.sqltext import pct, pretty, r2, top

HOT = "n_tup_hot_upd::DOUBLE / n_tup_upd::DOUBLE"
HOT_PCT = pct("n_tup_hot_upd", "n_tup_upd")
FK = """(SELECT c.server_id, c.constraint_name, c.table_schema, c.table_name, k.column_name, k.column_position, r.ref_table, r.ref_column
    FROM table_constraints c
    JOIN key_columns k ON k.server_id = c.server_id AND k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema
    JOIN constraint_columns r ON r.server_id = c.server_id AND r.constraint_name = c.constraint_name AND r.table_schema = c.table_schema
    WHERE c.constraint_type = 'FOREIGN KEY') fk"""

# An index entry: key columns rounded up to eight bytes, eight bytes of header and a line pointer of four; pages are nine tenths full.
INDEX_SIZES = """(SELECT *, greatest(0, index_size - expected_bytes) AS bloat_bytes FROM (
    SELECT i.server_id, i.schemaname, i.table_name, i.index_name, n_live_tup AS row_count, key_width, index_size,
           ((n_live_tup + per_page - 1) // per_page + 1) * 8192 AS expected_bytes
    FROM index_stats i
    JOIN (SELECT *, greatest(1, 7336 // (key_width + 12)) AS per_page FROM (
            SELECT k.server_id, k.relid, k.index_name, sum((coalesce(avg_width, 8) + 7) // 8 * 8)::BIGINT AS key_width
            FROM (SELECT server_id, relid, index_name, unnest(string_split(regexp_extract(indexdef, '\\((.*)\\)', 1), ', ')) AS attname FROM index_stats) k
            LEFT JOIN column_stats c ON c.server_id = k.server_id AND c.relid = k.relid AND c.attname = k.attname
            GROUP BY ALL) w) w ON w.server_id = i.server_id AND w.relid = i.relid AND w.index_name = i.index_name
    JOIN table_stats t ON t.server_id = i.server_id AND t.relid = i.relid) e) ix"""

SQL = {
    "ib1_index_bloat": f"""SELECT *, {pct('bloat_bytes', 'index_size')} AS bloat_percent, {pretty('bloat_bytes')} AS bloat_size FROM {INDEX_SIZES}""",
    "mi1_seq_scan_hotspots": f"""SELECT server_id, {FULL}, seq_scan AS sequential_scans, seq_tup_read AS sequential_tuples_read,
        idx_scan AS index_scans, idx_tup_fetch AS index_tuples_fetched, n_live_tup AS estimated_rows, {pretty('relation_size')} AS table_size,
        coalesce({pct('seq_scan', '(seq_scan + coalesce(idx_scan, 0))')}, 0.0) AS seq_scan_percentage,
        coalesce(seq_tup_read // nullif(seq_scan, 0), 0) AS avg_tuples_per_seq_scan, {I.SCAN_PRIORITY.sql()} AS index_recommendation_priority,
        'ANALYZE ' || schemaname || '.' || table_name || '; -- Check column distributions' AS suggested_analysis
        FROM ({top('SELECT * FROM table_stats WHERE n_live_tup > 1000', 20, 'seq_scan::HUGEINT * seq_tup_read DESC, seq_scan DESC, relid')}) x""",
    "mi2_fk_missing_index": f"""SELECT fk.server_id, fk.table_schema || '.' || fk.table_name AS table_name, column_name AS fk_column,
        ref_table AS references_table, ref_column AS references_column,
        CASE WHEN index_name IS NULL THEN '{I.MISSING}' ELSE 'EXISTS: ' || index_name END AS index_status,
        CASE WHEN index_name IS NULL THEN 'CREATE INDEX CONCURRENTLY idx_' || fk.table_name || '_' || column_name || ' ON ' || fk.table_schema
             || '.' || fk.table_name || ' (' || column_name || ');' ELSE '-- Index already exists' END AS suggested_index_creation,
        n_live_tup AS estimated_rows, {pretty('relation_size')} AS table_size
        FROM {FK} LEFT JOIN index_stats i ON i.server_id = fk.server_id AND i.schemaname = fk.table_schema AND i.table_name = fk.table_name
          AND i.indexdef LIKE '%' || fk.column_name || '%'
        LEFT JOIN table_stats t ON t.server_id = fk.server_id AND t.schemaname = fk.table_schema AND t.table_name = fk.table_name""",
    "mi3_unused_indexes": f"""SELECT i.server_id, i.schemaname || '.' || i.table_name AS table_name, index_name, index_size AS index_size_bytes,
        {pretty('index_size')} AS index_size, i.idx_scan AS times_used, {pretty('relation_size')} AS table_size, n_live_tup AS table_rows,
        {I.INDEX_ASSESSMENT.sql().replace('idx_scan', 'i.idx_scan')} AS usage_assessment,
        CASE WHEN i.idx_scan = 0 THEN 'DROP INDEX CONCURRENTLY ' || i.schemaname || '.' || index_name || '; -- Backup first!'
             ELSE '-- Index is being used' END AS drop_suggestion, indexdef AS index_definition
        FROM index_stats i LEFT JOIN table_stats t ON t.server_id = i.server_id AND t.relid = i.relid WHERE index_size > 1048576""",
    "mi4_query_index_candidates": f"""SELECT server_id, calls AS execution_count, total_exec_time AS total_execution_time_ms,
        {r2('mean_exec_time')} AS mean_execution_time_ms, shared_blks_read AS blocks_read_from_disk, shared_blks_hit AS blocks_read_from_cache,
        coalesce({pct('shared_blks_hit', '(shared_blks_read + shared_blks_hit)')}, 0.0) AS cache_hit_ratio, left(query, 200) AS query_sample,
        {I.QUERY_PRIORITY.sql()} AS optimization_priority,
        'EXPLAIN (ANALYZE, BUFFERS) ' || left(regexp_replace(query, '\\$[0-9]+', '?', 'g'), 100) || '...' AS explain_suggestion
        FROM ({top('''SELECT * FROM statements WHERE query NOT LIKE '%pg_stat_%' AND query NOT LIKE '%information_schema%' AND calls > 5
              AND (mean_exec_time > 100 OR calls > 100 OR shared_blks_read > 100)''', 20, 'calls * mean_exec_time DESC, calls DESC, queryid')}) x""",
    "mi5_partial_index_candidates": f"""SELECT server_id, schemaname || '.' || tn AS table_name, n_live_tup AS total_rows, {pretty('relation_size')} AS table_size,
        seq_scan AS sequential_scans, coalesce(seq_tup_read // nullif(seq_scan, 0), 0) AS avg_rows_per_seq_scan,
        {I.PARTIAL_INDEX.sql()} AS partial_index_recommendation,
        '-- Example: CREATE INDEX CONCURRENTLY idx_' || tn || '_partial ON ' || schemaname || '.' || tn || ' (column_name) WHERE condition;' AS partial_index_example
        FROM ({top('SELECT * EXCLUDE (table_name), table_name AS tn FROM table_stats WHERE n_live_tup > 10000 AND seq_scan > 10', 15,
                   'seq_scan::HUGEINT * seq_tup_read DESC, relid')}) x""",
    "mi6_index_summary": f"""SELECT *, {pretty('unused_index_bytes')} AS unused_index_size, {I.INDEX_SUMMARY.sql()} AS primary_recommendation
        FROM (SELECT i.server_id, unused_indexes, tables_needing_indexes, unused_index_bytes FROM
          (SELECT server_id, count(*) FILTER (idx_scan = 0) AS unused_indexes, sum(index_size) FILTER (idx_scan = 0)::BIGINT AS unused_index_bytes
           FROM index_stats GROUP BY server_id) i
          FULL JOIN (SELECT server_id, count(*) FILTER (seq_scan > idx_scan AND n_live_tup > 1000) AS tables_needing_indexes
                     FROM table_stats GROUP BY server_id) t ON t.server_id = i.server_id) x""",
    "a9_duplicate_indexes": """SELECT server_id, schemaname, table_name, array_to_string(indkey, ',') AS indkey, count(*) AS copies,
        min(index_name) AS first_index, sum(index_size)::BIGINT AS total_bytes FROM index_stats GROUP BY server_id, schemaname, table_name, index_stats.indkey HAVING count(*) > 1""",
    "a9l_duplicate_index_members": """SELECT i.server_id, i.schemaname, i.table_name, array_to_string(i.indkey, ',') AS indkey, index_name, index_size, copies
        FROM index_stats i JOIN (SELECT server_id, schemaname, table_name, indkey, count(*) AS copies FROM index_stats GROUP BY ALL) g
        ON g.server_id = i.server_id AND g.schemaname = i.schemaname AND g.table_name = i.table_name AND g.indkey = i.indkey WHERE copies > 1""",
    "hu1_hot_update_efficiency": f"""SELECT server_id, {FULL}, n_tup_upd AS total_updates, n_tup_hot_upd AS hot_updates, n_live_tup AS live_tuples,
        n_dead_tup AS dead_tuples, {HOT_PCT} AS hot_update_percent, n_tup_upd - n_tup_hot_upd AS non_hot_updates,
        {pretty('relation_size')} AS table_size, seq_scan + idx_scan AS total_scans
        FROM ({top('SELECT * FROM table_stats WHERE n_tup_upd > 100', 50, f'{HOT} NULLS LAST, n_tup_upd DESC, relid')}) x""",
    "hu2_fillfactor_candidates": f"""SELECT server_id, schemaname || '.' || table_name AS table_name, {HOT_PCT} AS hot_update_percent,
        'ALTER TABLE ' || schemaname || '.' || x.table_name || ' SET (fillfactor = 90);' AS suggested_command
        FROM ({top(f'SELECT * FROM table_stats WHERE n_tup_upd > 100 AND {HOT} < 0.5', 20, 'n_tup_upd DESC, relid')}) x""",
    "hu3_hot_update_document": f"""SELECT server_id, '2024-01-31T00:00:00Z' AS extracted_at, 100::BIGINT AS minimum_updates, count(*) AS table_count,
        string_agg(schemaname || '.' || table_name || ':' || CASE WHEN hp < 30 THEN 'high:80' WHEN hp < 50 THEN 'medium:90' ELSE 'info' END, ' '
                   ORDER BY ratio, n_tup_upd DESC, relid) AS tables_in_order, count(*) FILTER (hp < 50) AS recommendation_count
        FROM ({top(f'SELECT *, {HOT} AS ratio, {HOT_PCT} AS hp FROM table_stats WHERE n_tup_upd > 100', 50, 'ratio NULLS LAST, n_tup_upd DESC, relid')}) x
        GROUP BY server_id""",
}
