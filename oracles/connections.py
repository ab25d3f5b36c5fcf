from fleetstat.plans import connections as C
from oracles.sqltext import NOW, age_s, clock, older, pct, pretty

MINE = "(SELECT * FROM activity WHERE NOT is_collector) a"
COUNTS = """count(*) AS total, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'idle') AS idle,
    count(*) FILTER (state = 'idle in transaction') AS idle_tx, count(*) FILTER (state = 'idle in transaction (aborted)') AS aborted,
    count(*) FILTER (state LIKE 'idle in transaction%') AS stuck"""
LIMIT = "LEFT JOIN settings m ON m.server_id = c.server_id AND m.name = 'max_connections'"

SQL = {
    "cp1_connection_utilization": f"""SELECT *, {pct('total_connections', 'max_connections')} AS connection_utilization_percent,
        {C.UTILIZATION.sql()} AS utilization_status FROM (SELECT c.server_id, total AS total_connections, active AS active_connections,
        idle AS idle_connections, idle_tx AS idle_in_transaction, aborted AS idle_in_transaction_aborted, m.setting::BIGINT AS max_connections
        FROM (SELECT server_id, {COUNTS} FROM activity GROUP BY server_id) c {LIMIT}) x""",
    "cp2_connection_patterns": f"""SELECT *, {C.PATTERN.sql()} AS pattern_assessment FROM (SELECT server_id, datname AS database_name, application_name,
        usename AS username, client_addr, count(*) AS connection_count, count(*) FILTER (state = 'active') AS active_count,
        count(*) FILTER (state = 'idle') AS idle_count, count(*) FILTER (state LIKE 'idle in transaction%') AS idle_in_tx_count,
        round(avg({age_s('backend_start')})) AS avg_connection_age_seconds, max({age_s('backend_start')}) AS max_connection_age_seconds
        FROM {MINE} GROUP BY server_id, datname, application_name, usename, client_addr HAVING count(*) > 1) x""",
    "cp3_problem_connections": f"""SELECT server_id, pid, usename, datname, application_name, client_addr, state, {clock('bs')} AS backend_start,
        {clock('qs')} AS query_start, {clock('sc')} AS state_change, {age_s('bs')} AS connection_age_seconds, {age_s('qs')} AS query_age_seconds,
        {age_s('sc')} AS state_age_seconds, connection_status, {C.STATE_RANK.sql()} AS state_rank, left(query, 100) AS query_snippet
        FROM (SELECT * EXCLUDE (backend_start, query_start, state_change), backend_start AS bs, query_start AS qs, state_change AS sc,
              {C.CONNECTION_STATUS.sql()} AS connection_status FROM {MINE}
              WHERE (state = 'idle in transaction' AND {older('state_change', 60)}) OR state = 'idle in transaction (aborted)'
                 OR (state = 'active' AND {older('query_start', 300)}) OR {older('backend_start', 3600)}) x""",
    "cp4_pool_efficiency": f"""SELECT *, {pct('active_connections', 'total_connections')} AS active_percentage,
        {pct('idle_connections', 'total_connections')} AS idle_percentage, {pct('problematic_connections', 'total_connections')} AS problematic_percentage,
        {C.EFFICIENCY.sql()} AS pool_efficiency, {C.CONNECTION_HEALTH.sql()} AS connection_health
        FROM (SELECT c.server_id, total AS total_connections, active AS active_connections, idle AS idle_connections,
              stuck AS problematic_connections, age AS avg_connection_age_seconds, m.setting::BIGINT AS max_connections
              FROM (SELECT server_id, {COUNTS}, round(avg({age_s('backend_start')})) AS age FROM activity GROUP BY server_id) c {LIMIT}) x""",
    "cp5_transaction_churn": f"""SELECT server_id, datname AS database_name, numbackends AS current_backends, xact_commit + xact_rollback AS total_transactions,
        xact_commit AS committed_transactions, xact_rollback AS rolled_back_transactions,
        coalesce({pct('xact_rollback', '(xact_commit + xact_rollback)')}, 0.0) AS rollback_percentage, blks_read + blks_hit AS total_block_access,
        coalesce({pct('blks_hit', '(blks_read + blks_hit)')}, 0.0) AS cache_hit_ratio, deadlocks, temp_files,
        {pretty('temp_bytes')} AS temp_data_size, {clock('stats_reset')} AS stats_reset FROM database_stats
        WHERE datname NOT IN ('template0', 'template1')""",
    "cp6_pool_advice": f"""SELECT c.server_id, total AS total_connections, app_count, client_count,
        CASE WHEN idle > 2 * active THEN 'Consider connection pooling: ' || idle || ' idle vs ' || active || ' active connections'
             WHEN total > 0.8 * m.setting::BIGINT THEN 'Increase max_connections or implement pooling: ' || total || '/' || m.setting || ' connections used'
             WHEN stuck > 5 THEN 'Fix application logic: ' || stuck || ' idle-in-transaction connections detected'
             WHEN app_count > 10 THEN 'Consider connection multiplexing: ' || app_count || ' different applications connecting'
             ELSE 'Connection usage appears optimal' END AS primary_recommendation,
        CASE WHEN idle > 2 * active THEN 'Suggested pool size: ' || greatest(active + 2, 5) || ' connections per database'
             WHEN total > 0.8 * m.setting::BIGINT THEN 'Consider PgBouncer with pool_mode=transaction for better efficiency'
             WHEN stuck > 5 THEN 'Review application transaction management and connection handling'
             ELSE 'Monitor connection patterns and adjust as workload changes' END AS detailed_guidance
        FROM (SELECT server_id, {COUNTS}, count(DISTINCT application_name) AS app_count, count(DISTINCT client_addr) AS client_count
              FROM {MINE} GROUP BY server_id) c {LIMIT}""",
    "cp7_pooling_benefit": f"""SELECT *, {C.BENEFIT.sql()} AS pooling_benefit_assessment,
        'Estimated pool size needed: ' || greatest(would_be_server_active + 2, 5) || ' per database' AS suggested_pool_config
        FROM (SELECT server_id, count(*) AS total_backend_connections, count(DISTINCT (datname, usename)) AS unique_db_user_combinations,
              round(avg({age_s('backend_start')})) AS avg_backend_age_seconds, count(*) FILTER (state = 'active') AS would_be_server_active,
              count(*) FILTER (state <> 'active') AS would_be_server_idle FROM {MINE} GROUP BY server_id) x""",
    "cp8_connections_by_hour": f"""SELECT h.server_id, connection_start_hour, connections_started, currently_active, avg_age_seconds,
        CASE WHEN connections_started > 0.2 * n THEN 'Peak connection period' ELSE 'Normal connection period' END AS period_classification
        FROM (SELECT server_id, hour(backend_start)::INT AS connection_start_hour, count(*) AS connections_started,
              count(*) FILTER (state = 'active') AS currently_active, round(avg({age_s('backend_start')}))::BIGINT AS avg_age_seconds
              FROM {MINE} WHERE backend_start > {NOW} - INTERVAL 24 HOUR GROUP BY server_id, hour(backend_start)) h
        JOIN (SELECT server_id, count(*) AS n FROM {MINE} GROUP BY server_id) t ON t.server_id = h.server_id""",
}
