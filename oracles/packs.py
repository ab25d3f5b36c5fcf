from oracles.sqltext import age_s, clock, pct, pretty, r2, top

SQL = {
    "tp1_connections_per_database": "SELECT server_id, datname, count(*) AS connections FROM activity GROUP BY server_id, datname",
    "tp2_connections_available": """SELECT a.server_id, m.setting::BIGINT AS max_conn, used_conn, m.setting::BIGINT - used_conn AS available
        FROM (SELECT server_id, count(*) AS used_conn FROM activity GROUP BY server_id) a
        JOIN settings m ON m.server_id = a.server_id AND m.name = 'max_connections'""",
    "tp3_long_running": f"SELECT server_id, pid, {age_s('query_start')} AS runtime_seconds, usename, datname, state, query FROM activity WHERE state <> 'idle'",
    "tp4_waiting_sessions": "SELECT server_id, pid, wait_event_type, wait_event, state, query FROM activity WHERE wait_event IS NOT NULL",
    "tp5_dead_tuples": f"""SELECT server_id, table_name, n_dead_tup, n_live_tup, {clock('last_vacuum')} AS last_vacuum,
        {clock('last_autovacuum')} AS last_autovacuum FROM table_stats WHERE n_dead_tup > 1000""",
    "tp6_largest_tables": f"""SELECT server_id, schemaname, table_name, total_relation_size AS total_bytes, {pretty('total_relation_size')} AS total_size
        FROM ({top('SELECT * FROM table_stats', 10, 'total_relation_size DESC, relid')}) x""",
    "tp7_largest_indexes": f"""SELECT server_id, index_name, index_size AS index_bytes, {pretty('x.index_size')} AS index_size, idx_scan AS scans
        FROM ({top('SELECT * FROM index_stats', 10, 'index_size DESC, index_name')}) x""",
    "tp8_zero_scan_indexes": "SELECT server_id, schemaname, table_name, index_name, idx_scan, index_size AS index_bytes FROM index_stats WHERE idx_scan = 0",
    "tp9_top_by_blocks_read": f"""SELECT server_id, queryid, query, shared_blks_read, local_blks_read, temp_blks_read
        FROM ({top('SELECT * FROM statements', 10, 'shared_blks_read DESC, queryid')}) x""",
    "tp10_database_hit_ratio": """SELECT server_id, sum(blks_hit)::DOUBLE / nullif(sum(blks_hit) + sum(blks_read), 0)::DOUBLE AS hit_ratio
        FROM database_stats GROUP BY server_id""",
    "tp11_connection_summary": "SELECT server_id, datname, usename, client_addr, state, count(*) AS conn_count FROM activity GROUP BY ALL",
    "tp12_hot_ratio": f"SELECT server_id, table_name, n_tup_upd, n_tup_hot_upd, {pct('n_tup_hot_upd', 'n_tup_upd')} AS hot_update_ratio FROM table_stats",
    "tp13_top_by_plan_time": f"""SELECT server_id, queryid, query, calls, total_plan_time, {r2('x.mean_plan_time', 4)} AS mean_plan_time
        FROM ({top('SELECT * FROM statements', 10, 'total_plan_time DESC, queryid')}) x""",
    "tp14_hit_ratio_int": top("""SELECT server_id, queryid, query, calls,
        100 * shared_blks_hit // nullif(shared_blks_hit + shared_blks_read, 0) AS hit_ratio FROM statements""", 10, "hit_ratio NULLS LAST, queryid"),
    "tp15_top_by_temp": f"SELECT server_id, queryid, query, temp_blks_written FROM ({top('SELECT * FROM statements', 10, 'temp_blks_written DESC, queryid')}) x",
    "tp16_temp_by_database": "SELECT server_id, datname, temp_bytes, temp_files FROM database_stats",
    "tp17_overhead_size": f"""SELECT server_id, schemaname, table_name, {pretty('total_relation_size')} AS total_size, {pretty('relation_size')} AS table_size,
        overhead_bytes, {pretty('overhead_bytes')} AS index_and_toast_size FROM ({top(
        'SELECT *, total_relation_size - relation_size AS overhead_bytes FROM table_stats', 10, 'overhead_bytes DESC, relid')}) x""",
    "tp18_never_maintained": f"""SELECT server_id, schemaname, table_name, {clock('t.last_vacuum')} AS last_vacuum, {clock('t.last_autovacuum')} AS last_autovacuum,
        {clock('t.last_analyze')} AS last_analyze, {clock('t.last_autoanalyze')} AS last_autoanalyze FROM table_stats t
        WHERE t.last_vacuum IS NULL OR t.last_analyze IS NULL""",
    "tp19_autovacuum_workers": """SELECT a.server_id, running_autovacuums, m.setting::BIGINT AS max_workers
        FROM (SELECT server_id, count(*) FILTER (query LIKE '%autovacuum%') AS running_autovacuums FROM activity GROUP BY server_id) a
        JOIN settings m ON m.server_id = a.server_id AND m.name = 'autovacuum_max_workers'""",
    "tp20_missing_stats": f"""SELECT server_id, table_name, n_live_tup, n_dead_tup, {clock('t.last_analyze')} AS last_analyze,
        {clock('t.last_autoanalyze')} AS last_autoanalyze FROM table_stats t WHERE t.last_analyze IS NULL OR t.last_autoanalyze IS NULL""",
    "tp21_ddl_in_flight": """SELECT server_id, pid, query, wait_event_type, wait_event FROM activity
        WHERE regexp_matches(query, '(alter|create|drop)', 'i') AND state <> 'idle'""",
    "tp22_tablespace_sizes": f"SELECT server_id, spcname, size_bytes, {pretty('size_bytes')} AS size, location FROM tablespaces",
    "tp23_mentions_deadlock": "SELECT server_id, pid, usename, datname, state, query FROM activity WHERE query ILIKE '%deadlock%'",
    "tp24_low_use_indexes": f"""SELECT server_id, index_name, index_size AS index_bytes, {pretty('index_size')} AS size, idx_scan
        FROM ({top('SELECT * FROM index_stats WHERE idx_scan < 50', 10, 'index_size DESC, index_name')}) x""",
    "j15_vacuum_progress": """SELECT p.server_id, p.pid, r.schemaname || '.' || r.table_name AS relation_name, phase, wait_event_type, wait_event, query
        FROM progress_vacuum p JOIN activity a ON a.server_id = p.server_id AND a.pid = p.pid JOIN relations r ON r.server_id = p.server_id AND r.oid = p.relid""",
}
