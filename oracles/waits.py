from fleetstat.plans.waits import ADVICE_HEADER, IO_EVENT, STATE, WAIT_ISSUE, WAIT_SUGGESTION, WAL_EVENT, WAL_EVENTS
from oracles.sqltext import age_s, clock, older, pct, r2, top

OBJECT = ["locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid", "objsubid"]


def pairs(select: str, keys: int) -> str:
    same = " AND ".join(f"w.{k} IS NOT DISTINCT FROM h.{k}" for k in OBJECT[:keys])
    return f"""SELECT w.server_id, {select} FROM locks w
        JOIN activity wa ON wa.server_id = w.server_id AND wa.pid = w.pid
        JOIN locks h ON h.server_id = w.server_id AND {same} AND h.pid <> w.pid
        JOIN activity ha ON ha.server_id = h.server_id AND ha.pid = h.pid
        WHERE NOT w.granted"""


SHORT = "w.pid AS blocked_pid, wa.query AS blocked_query, h.pid AS blocking_pid, ha.query AS blocking_query"

SQL = {
    "we1_wait_summary": f"""
        SELECT server_id, wait_event_type, wait_event, count(*) AS waiting_processes,
               {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY server_id)')} AS percentage
        FROM activity WHERE wait_event IS NOT NULL AND state = 'active' GROUP BY server_id, wait_event_type, wait_event""",
    "we2_lock_waits": pairs(f"""w.pid AS blocked_pid, wa.usename AS blocked_user, h.pid AS blocking_pid, ha.usename AS blocking_user,
               wa.query AS blocked_statement, ha.query AS current_statement_in_blocking_process, wa.wait_event, wa.wait_event_type,
               {age_s('wa.query_start')} AS blocked_duration_seconds""", 10),
    "we3_io_waits": f"""
        SELECT server_id, wait_event_type, wait_event, count(*) AS processes, {IO_EVENT.sql()} AS description
        FROM activity WHERE wait_event_type = 'IO' AND wait_event IS NOT NULL GROUP BY server_id, wait_event_type, wait_event""",
    "we4_state_breakdown": f"""
        SELECT server_id, state, count(*) AS processes, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY server_id)')} AS percentage,
               {STATE.sql()} AS description FROM activity GROUP BY server_id, state""",
    "we5_long_running_active": f"""
        SELECT server_id, pid, usename, application_name, client_addr, wait_event_type, wait_event, state,
               {age_s('query_start')} AS duration_seconds, {age_s('state_change')} AS state_duration_seconds,
               left(query, 100) || '...' AS query_snippet
        FROM ({top(f"SELECT * FROM activity WHERE state = 'active' AND {older('query_start', 30)}", 20,
                   f"{age_s('query_start')} DESC, pid")}) x""",
    "we6_slow_statements": f"""
        SELECT server_id, queryid, calls, total_exec_time, {r2('mean_exec_time')} AS mean_exec_time,
               {r2('stddev_exec_time')} AS stddev_exec_time, rows, left(query, 80) || '...' AS query_snippet
        FROM ({top('SELECT * FROM statements WHERE mean_exec_time > 1000', 10, 'mean_exec_time DESC, queryid')}) x""",
    "we7_pool_by_application": f"""
        SELECT server_id, application_name, count(*) AS total_connections,
               count(*) FILTER (state = 'active') AS active_connections, count(*) FILTER (state = 'idle') AS idle_connections,
               count(*) FILTER (state = 'idle in transaction') AS idle_in_transaction,
               count(*) FILTER (wait_event IS NOT NULL) AS waiting_connections,
               round(avg({age_s('query_start')})) AS avg_query_duration_seconds
        FROM activity WHERE application_name IS NOT NULL GROUP BY server_id, application_name""",
    "we8_wal_checkpoint_waits": f"""
        SELECT server_id, wait_event, count(*) AS processes, coalesce({WAL_EVENT.sql()}, wait_event) AS description
        FROM activity WHERE wait_event IN ({', '.join(f"'{e}'" for e in WAL_EVENTS)}) GROUP BY server_id, wait_event""",
    "we9_background_workers": """
        SELECT server_id, backend_type, count(*) AS processes, count(*) FILTER (wait_event IS NOT NULL) AS waiting_processes,
               coalesce(string_agg(DISTINCT wait_event, ', ' ORDER BY wait_event), '') AS wait_events
        FROM activity WHERE backend_type <> 'client backend' GROUP BY server_id, backend_type""",
    "we10_wait_advice": f"""
        WITH w AS (SELECT server_id, wait_event_type, wait_event, count(*) AS processes FROM activity
                   WHERE wait_event IS NOT NULL AND state = 'active' GROUP BY ALL)
        SELECT DISTINCT server_id, '{ADVICE_HEADER}' AS analysis, '' AS suggestion, NULL::BIGINT AS processes FROM activity
        UNION ALL
        SELECT server_id, coalesce({WAIT_ISSUE.sql()}, wait_event_type || ' Wait Detected'),
               coalesce({WAIT_SUGGESTION.sql()}, 'Review PostgreSQL configuration for ' || wait_event), processes
        FROM w WHERE processes > 1""",
    "lk1_locks_detail": f"""
        SELECT l.server_id, locktype, database, relation, page, tuple, virtualxid, transactionid, mode, granted, l.pid, usename,
               application_name, client_addr, {age_s('query_start')} AS query_age_seconds,
               {clock('query_start')} AS query_start, state, query
        FROM locks l LEFT JOIN activity a ON a.server_id = l.server_id AND a.pid = l.pid""",
    "lk2_blocking_detail": pairs(f"""w.pid AS blocked_pid, wa.usename AS blocked_user, wa.application_name AS blocked_application,
               w.mode AS blocked_mode, wa.query AS blocked_query, {clock('wa.query_start')} AS blocked_query_start,
               {age_s('wa.query_start')} AS blocked_seconds, h.pid AS blocking_pid, ha.usename AS blocking_user,
               ha.application_name AS blocking_application, h.mode AS blocking_mode, ha.query AS blocking_query,
               {age_s('ha.query_start')} AS blocking_seconds""", 10),
    "j1b_blocking_by_tuple": pairs(SHORT, 5),
    "j1c_blocking_by_relation": pairs(SHORT, 3),
    "j3_relation_locks": """
        SELECT l.server_id, l.pid, mode, granted, relation, query FROM locks l
        JOIN activity a ON a.server_id = l.server_id AND a.pid = l.pid WHERE relation IS NOT NULL""",
    "lk3_locks_held_long": f"""
        SELECT l.server_id, l.pid, mode, relation, granted, {age_s('query_start')} AS duration_seconds, query
        FROM locks l JOIN activity a ON a.server_id = l.server_id AND a.pid = l.pid
        WHERE granted AND {older('query_start', 300)}""",
}
