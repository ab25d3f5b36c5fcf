from oracles.resources import DEAD, FULL
from oracles.sqltext import age_s, clock, older, pct, pretty, r2, top

SQL = {
    "dg1_primary_flag": "SELECT server_id, CASE WHEN in_recovery THEN 0 ELSE 1 END AS status FROM servers",
    "dg2_connection_count": "SELECT server_id, count(*) AS connections FROM activity GROUP BY server_id",
    "dg3_database_size": "SELECT server_id, datname, size_bytes FROM database_stats",
    "dg4_database_hit_percent": f"""SELECT server_id, datname, {pct('sum(blks_hit)', '(sum(blks_hit) + sum(blks_read))')} AS cache_hit_ratio
        FROM database_stats GROUP BY server_id, datname""",
    "dg8_lock_mode_counts": "SELECT server_id, mode, count(*) AS locks FROM locks GROUP BY server_id, mode",
    "dg9_top_wait_events": top("""SELECT server_id, wait_event_type, wait_event, count(*) AS processes FROM activity WHERE wait_event IS NOT NULL
        GROUP BY server_id, wait_event_type, wait_event""", 10, "processes DESC, wait_event_type, wait_event"),
    "dg10_slow_queries_panel": f"""SELECT server_id, queryid, calls, {r2('total_exec_time')} AS total_time_ms, {r2('mean_exec_time')} AS mean_time_ms,
        left(query, 100) AS query_snippet FROM ({top('SELECT * FROM statements', 10, 'mean_exec_time DESC, queryid')}) x""",
    "dg12_table_io_panel": f"""SELECT server_id, {FULL}, heap_blks_read, heap_blks_hit, {pct('heap_blks_hit', '(heap_blks_hit + heap_blks_read)')} AS hit_percent
        FROM ({top('SELECT * FROM table_stats WHERE heap_blks_hit + heap_blks_read > 0', 15, 'heap_blks_hit + heap_blks_read DESC, relid')}) x""",
    "dg13_superusers": "SELECT server_id, rolname, rolsuper, rolcreaterole, rolcreatedb, rolcanlogin FROM roles WHERE rolsuper",
    "dg14_failed_logins": """SELECT server_id, count(*) FILTER (state = 'idle' AND query = '<authentication failed>') AS failed_logins
        FROM activity GROUP BY server_id""",
    "dg15_database_acls": "SELECT server_id, datname, datacl FROM database_stats WHERE datacl IS NOT NULL",
    "dg16_long_transactions": f"""SELECT server_id, pid, usename, application_name, client_addr, {age_s('xact_start')} AS duration_seconds,
        left(query, 100) AS query_snippet FROM activity WHERE {older('xact_start', 3600)} AND state <> 'idle'""",
    "dg17_connections_by_state": "SELECT server_id, state, count(*) AS connections FROM activity GROUP BY server_id, state",
    "dg18_tables_needing_vacuum": f"""SELECT server_id, schemaname, table_name, n_dead_tup, n_live_tup, {DEAD} AS dead_tuple_ratio,
        {clock('x.last_autovacuum')} AS last_autovacuum FROM ({top('SELECT * FROM table_stats WHERE n_dead_tup > 0.1 * n_live_tup', 10, f'{DEAD} DESC, relid')}) x""",
    "dg18b_bloated_tables": f"""SELECT server_id, schemaname, table_name, {pretty('total_relation_size')} AS size, n_dead_tup,
        {clock('x.last_vacuum')} AS last_vacuum, {clock('x.last_autovacuum')} AS last_autovacuum
        FROM ({top('SELECT * FROM table_stats WHERE n_dead_tup > 10000', 15, 'n_dead_tup DESC, relid')}) x""",
}
