from fleetstat.plans.rules import ALERT_RULES
from oracles import admin, config, connections, indexes, partitions, resources, security, servers
from oracles.resources import DEAD
from oracles.servers import CUR, SLOTS
from oracles.sqltext import age_s, lsn, pct, pretty, top

TOKEN = "^(CRITICAL|ERROR|HIGH|WARNING|MEDIUM|NOTICE|INFO|LOW|OK|NORMAL|MISSING|POOR|EMERGENCY)"


def finding(source: str, check: str, object: str, message: str, value: str, where: str = "true") -> str:
    return f"""SELECT server_id, '{check}' AS check_name, ({object})::VARCHAR AS object, {message} AS message, ({value})::DOUBLE AS value
        FROM ({source}) src WHERE {where}"""


QUICK = [
    finding(connections.SQL["cp1_connection_utilization"], "Connection Analysis", "'connections'", "utilization_status", "connection_utilization_percent"),
    finding(connections.SQL["cp3_problem_connections"], "Connection Analysis", "pid", "connection_status", "state_age_seconds", "connection_status <> 'Normal'"),
    finding("SELECT server_id, count(*) FILTER (NOT granted) AS n FROM locks GROUP BY server_id", "Lock Analysis", "'locks'",
            "CASE WHEN n > 0 THEN 'WARNING: ' || n || ' ungranted locks' ELSE 'OK: no ungranted locks' END", "n"),
    finding(servers.SQL["bk5_slot_health"], "Replication Status", "slot_name", "slot_health", "lag_bytes"),
    finding(servers.SQL["bk1_backup_complexity"], "Transaction Wraparound", "database_name", "wraparound_risk", "xid_age"),
    finding(servers.SQL["bk8_backup_readiness"], "Backup Validation", "'server'", "overall_status", "NULL"),
    finding(servers.SQL["bk3_archiver_health"], "Backup Validation", "'archiver'", "failure_status", "total_failed"),
]
FULL = QUICK + [
    finding(resources.SQL["bl2_bloat_bands"], "Table Bloating", "table_name", "upper(band)", "dead_tuple_percent"),
    finding(resources.SQL["rm5_database_io"], "Buffer Performance", "database_name", "cache_performance", "cache_hit_ratio"),
    finding(indexes.SQL["mi3_unused_indexes"], "Index Analysis", "index_name", "'NOTICE: ' || usage_assessment", "index_size_bytes", "times_used = 0"),
    finding(indexes.SQL["hu2_fillfactor_candidates"], "HOT Updates", "table_name", "'WARNING: Low HOT update percentage'", "hot_update_percent"),
    finding(partitions.SQL["pm2_partition_balance"], "Partition Management", "parent_table", "partition_count_assessment", "partition_count"),
    finding(security.SQL["pa1_role_risk"], "Security Audit", "role_name", "security_risk_level", "NULL"),
    finding(security.SQL["pa6_function_risk"], "Security Audit", "function_name", "security_risk", "NULL"),
    finding(admin.SQL["ad8_risky_extensions"], "Extensions Audit", "extname", "'WARNING: extension reaches outside the database'", "NULL"),
    finding(admin.SQL["ad6_unexpected_owners"], "Table Ownership", "schemaname || '.' || table_name", "'NOTICE: unexpected owner'", "NULL"),
    finding(indexes.SQL["mi2_fk_missing_index"], "Foreign Constraints", "table_name || '.' || fk_column", "index_status", "estimated_rows",
            "index_status LIKE 'MISSING%'"),
]


def findings(parts: list[str]) -> str:
    return f"""SELECT * EXCLUDE (token), CASE token WHEN 'MISSING' THEN 'WARNING' WHEN 'POOR' THEN 'WARNING' WHEN 'EMERGENCY' THEN 'CRITICAL'
        WHEN 'NORMAL' THEN 'OK' WHEN '' THEN 'INFO' ELSE token END AS severity
        FROM (SELECT *, regexp_extract(upper(message), '{TOKEN}', 1) AS token FROM ({' UNION ALL '.join(parts)}) parts) marked"""


def kv(source: str, **values: str) -> str:
    return " UNION ALL ".join(f"SELECT server_id, '{k.replace('_', ' ')}' AS metric, ({v})::VARCHAR AS value FROM {source}" for k, v in values.items())


FACTS = f"""(SELECT v.server_id, grade, backup, ratio, config_issues, relation_count, no_pk, monitored, autovacuum, used FROM servers v
    LEFT JOIN (SELECT server_id, overall_security_grade AS grade FROM ({security.SQL['pa9_security_grade']}) a) g ON g.server_id = v.server_id
    LEFT JOIN (SELECT server_id, overall_status AS backup FROM ({servers.SQL['bk8_backup_readiness']}) a) b ON b.server_id = v.server_id
    LEFT JOIN (SELECT server_id, {pct('sum(blks_hit)', '(sum(blks_hit) + sum(blks_read))')} AS ratio FROM database_stats GROUP BY server_id) r ON r.server_id = v.server_id
    LEFT JOIN (SELECT server_id, count(*) FILTER (recommendation LIKE 'CRITICAL%') AS config_issues FROM ({config.SQL['ca10_configuration_advice']}) a GROUP BY server_id) c
      ON c.server_id = v.server_id
    LEFT JOIN (SELECT server_id, count(*) AS no_pk FROM ({admin.SQL['ad9_tables_without_primary_key']}) a GROUP BY server_id) p ON p.server_id = v.server_id
    LEFT JOIN (SELECT server_id, count(*) AS relation_count FROM relations GROUP BY server_id) t ON t.server_id = v.server_id
    LEFT JOIN (SELECT server_id, count(*) FILTER (extname = 'pg_stat_statements') AS monitored FROM extensions GROUP BY server_id) m ON m.server_id = v.server_id
    LEFT JOIN (SELECT server_id, setting AS autovacuum FROM settings WHERE name = 'autovacuum') s ON s.server_id = v.server_id
    LEFT JOIN (SELECT server_id, connection_utilization_percent AS used FROM ({connections.SQL['cp1_connection_utilization']}) a) u ON u.server_id = v.server_id) f"""


def check(category: str, known: str, passes: str, warns: str) -> str:
    return f"""SELECT server_id, '{category}' AS category, CASE WHEN NOT ({known}) THEN 'UNKNOWN' WHEN {passes} THEN 'PASS' WHEN {warns} THEN 'WARN' ELSE 'FAIL' END AS status
        FROM {FACTS}"""


READINESS = " UNION ALL ".join([
    check("SECURITY", "grade IS NOT NULL", "grade LIKE 'GOOD%'", "grade NOT LIKE 'CRITICAL%'"),
    check("BACKUP", "backup IS NOT NULL", "backup LIKE 'OK%'", "backup LIKE 'WARNING%'"),
    check("PERFORMANCE", "ratio IS NOT NULL", "ratio > 95", "ratio > 90"),
    check("CONFIGURATION", "config_issues IS NOT NULL", "config_issues = 0", "true"),
    check("SCHEMA", "relation_count IS NOT NULL", "coalesce(no_pk, 0) = 0", "true"),
    check("MONITORING", "monitored IS NOT NULL", "monitored > 0", "true"),
    check("REPLICATION", "EXISTS (SELECT 1 FROM repl_stats)", "true", "true"),
    check("MAINTENANCE", "autovacuum IS NOT NULL", "autovacuum = 'on'", "false"),
    check("CAPACITY", "used IS NOT NULL", "used < 70", "used < 85"),
])


def s(source: str, metric: str, object: str, value: str) -> str:
    return f"SELECT server_id, '{metric}' AS metric, ({object})::VARCHAR AS object, ({value})::DOUBLE AS value FROM {source}"


BLOCKED = """(SELECT DISTINCT w.server_id, w.pid, wa.query_start FROM locks w
    JOIN activity wa ON wa.server_id = w.server_id AND wa.pid = w.pid
    JOIN locks h ON h.server_id = w.server_id AND h.locktype = w.locktype AND h.database IS NOT DISTINCT FROM w.database
      AND h.relation IS NOT DISTINCT FROM w.relation AND h.transactionid IS NOT DISTINCT FROM w.transactionid AND h.pid <> w.pid
    JOIN activity ha ON ha.server_id = h.server_id AND ha.pid = h.pid WHERE NOT w.granted) x"""
COUNTS = """(SELECT c.*, m.setting::BIGINT AS lim FROM (SELECT server_id, count(*) AS total, count(*) FILTER (state = 'active') AS active,
    count(*) FILTER (state = 'idle in transaction') AS idle_tx FROM activity GROUP BY server_id) c
    LEFT JOIN settings m ON m.server_id = c.server_id AND m.name = 'max_connections') x"""
STANDBY = f"(SELECT r.*, {CUR} - {lsn('replay_lsn')} AS bytes FROM repl_stats r JOIN servers v ON v.server_id = r.server_id) x"
SAMPLES = "(" + " UNION ALL ".join([
    s(BLOCKED, "blocked_seconds", "pid", age_s("query_start")),
    s("database_stats", "xid_percent", "datname", pct("xid_age", "2000000000")),
    s("database_stats", "xid_age", "datname", "xid_age"),
    s(f"(SELECT server_id, {pct('sum(blks_hit)', '(sum(blks_hit) + sum(blks_read))')} AS v FROM database_stats GROUP BY server_id) x", "cache_hit_percent", "'server'", "v"),
    s("table_stats", "bloat_percent", "schemaname || '.' || table_name", DEAD),
    s(indexes.INDEX_SIZES, "index_bloat_percent", "index_name", pct("bloat_bytes", "index_size")),
    s(COUNTS, "connection_percent", "'server'", pct("total", "lim")),
    s(COUNTS, "idle_in_transaction_percent", "'server'", pct("idle_tx", "total")),
    s(COUNTS, "pool_efficiency_percent", "'server'", pct("active", "total")),
    s(STANDBY, "sync_replication_lag_seconds", "application_name", "CASE WHEN sync_state = 'sync' THEN replay_lag_s END"),
    s(STANDBY, "async_replication_lag_seconds", "application_name", "CASE WHEN sync_state = 'async' THEN replay_lag_s END"),
    s(STANDBY, "replication_lag_seconds", "application_name", "replay_lag_s"),
    s(STANDBY, "replication_lag_bytes", "application_name", "bytes"),
    s(STANDBY, "standby_catchup", "application_name", "CASE WHEN state = 'catchup' THEN 1 ELSE 0 END"),
    s("(SELECT server_id, max(replay_lag_s) AS v FROM repl_stats GROUP BY server_id) x", "max_replication_lag_seconds", "'server'", "v"),
    s(f"(SELECT * FROM {SLOTS} WHERE NOT active) y", "inactive_slot_lag_bytes", "slot_name", "lag_bytes"),
    s("(SELECT v.server_id, count(r.pid) AS n FROM servers v LEFT JOIN repl_stats r ON r.server_id = v.server_id GROUP BY v.server_id) x",
      "active_replicas", "'server'", "n"),
    s("(SELECT server_id, count(*) FILTER (NOT granted) AS n FROM locks GROUP BY server_id) x", "ungranted_locks", "'server'", "n"),
    s("""(SELECT l.server_id, count(*) AS n FROM locks l JOIN activity a ON a.server_id = l.server_id AND a.pid = l.pid
        WHERE mode = 'AccessExclusiveLock' AND hour(query_start) BETWEEN 9 AND 16 GROUP BY l.server_id) x""",
      "access_exclusive_locks_in_business_hours", "'server'", "n"),
    s("""(SELECT l.server_id, count(*) AS n FROM locks l JOIN activity a ON a.server_id = l.server_id AND a.pid = l.pid
        WHERE granted AND state LIKE 'idle in transaction%' GROUP BY l.server_id) x""", "locks_held_idle_in_transaction", "'server'", "n"),
    s("""(SELECT server_id, locktype, database, relation, transactionid, count(*) AS n FROM locks WHERE NOT granted GROUP BY ALL) x""",
      "waiters_on_object", "concat_ws('/', locktype, database, relation, transactionid)", "n"),
]) + ") samples"


def alerts(rule_set: str) -> str:
    # Rules of one set are counted one by one: a sample breaching two of them is listed twice.
    parts = []
    for name, metric, low, high, inclusive, severity, lasting in ALERT_RULES:
        # One scrape has no duration, so rules that must last do not fire on it.
        if name != rule_set or lasting:
            continue
        e = "=" if inclusive else ""
        bounds = [f"metric = '{metric}'"] + ([f"value >{e} {low}"] if low is not None else []) + ([f"value <{e} {high}"] if high is not None else [])
        parts.append(f"SELECT server_id, metric, object, value, '{severity}' AS severity FROM {SAMPLES} WHERE {' AND '.join(bounds)}")
    return " UNION ALL ".join(parts)


def lasting(metric: str, value: str, breach: str, severity: str, seconds: int, gap: int) -> str:
    """Runs of a breach over scrapes, from the scrape on at which it has lasted long enough."""
    return f"""SELECT server_id, '{metric}' AS metric, application_name AS object, '{severity}' AS severity,
            strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(min(snap_ts), '%Y-%m-%d %H:%M:%S') AS first_fired,
            strftime(max(snap_ts), '%Y-%m-%d %H:%M:%S') AS last_fired, count(*) AS scrapes, max(value) AS worst_value
        FROM (SELECT *, max(start) OVER (PARTITION BY server_id, application_name ORDER BY snap_ts, value ROWS UNBOUNDED PRECEDING) AS since
              FROM (SELECT *, CASE WHEN breach AND (prev_ts IS NULL OR NOT prev_breach OR epoch_us(snap_ts) - epoch_us(prev_ts) > {gap}::BIGINT * 1000000) THEN snap_ts END AS start
                    FROM (SELECT *, lag(snap_ts) OVER w AS prev_ts, lag(breach) OVER w AS prev_breach
                          FROM (SELECT server_id, application_name, snap_ts, ({value})::DOUBLE AS value, {breach} AS breach FROM repl_history) b
                          WINDOW w AS (PARTITION BY server_id, application_name ORDER BY snap_ts, value)) l) m) r
        WHERE breach AND epoch_us(snap_ts) - epoch_us(since) >= {seconds}::BIGINT * 1000000 GROUP BY server_id, application_name, since"""


RANK = "CASE severity " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(
    ("CRITICAL", "ERROR", "HIGH", "WARNING", "MEDIUM", "NOTICE", "INFO", "LOW", "OK"))) + " ELSE 9 END"

SQL = {
    "ck1_health_findings": findings(FULL),
    "ck1q_health_findings_quick": findings(QUICK),
    "ck6_severity_report": f"SELECT server_id, check_name, severity, count(*) AS findings FROM ({findings(FULL)}) f GROUP BY server_id, check_name, severity",
    "s7_report_json": f"""SELECT a.server_id, CASE WHEN v.server_id IS NOT NULL THEN 'postgres' ELSE 'postgres' END AS database, v.version, sections_in_order FROM (
        SELECT server_id, string_agg(check_name || '|' || n || '|' || worst, ';' ORDER BY check_name) AS sections_in_order FROM (
          SELECT server_id, check_name, count(*) AS n, arg_min(message, ({RANK}, message)) AS worst FROM ({findings(QUICK)}) f GROUP BY server_id, check_name) g
        GROUP BY server_id) a LEFT JOIN servers v ON v.server_id = a.server_id""",
    "s7l_report_lines": f"SELECT server_id, check_name, object, severity, message, value FROM ({findings(FULL)}) f",
    "ck2_incident_snapshot": kv("""(SELECT server_id, count(*) AS total, count(*) FILTER (state = 'active') AS active,
        count(*) FILTER (state = 'idle in transaction') AS idle_tx, count(*) FILTER (wait_event IS NOT NULL) AS waiting FROM activity GROUP BY server_id) x""",
        Connection_Count="total", Active_Queries="active", Idle_in_Transaction="idle_tx", Waiting_Queries="waiting"),
    "ck2l_incident_long_queries": f"""SELECT server_id, pid, duration_seconds, query FROM ({top(
        f"SELECT *, {age_s('query_start')} AS duration_seconds FROM activity WHERE {age_s('query_start')} > 300", 10, 'duration_seconds DESC, pid')}) x""",
    "ck3_daily_metrics": kv(f"""(SELECT coalesce(d.server_id, a.server_id) AS server_id, ratio, size, active FROM
        (SELECT server_id, {pct('sum(blks_hit)', '(sum(blks_hit) + sum(blks_read))')} AS ratio, sum(size_bytes) AS size FROM database_stats GROUP BY server_id) d
        FULL JOIN (SELECT server_id, count(*) FILTER (state = 'active') AS active FROM activity GROUP BY server_id) a ON a.server_id = d.server_id) x""",
        Buffer_Hit_Ratio="printf('%.2f%%', ratio)", Active_Connections="active", Database_Size=pretty("size")),
    "ck7_basic_counts": " UNION ALL ".join(
        f"SELECT server_id, '{n}' AS metric, ({v})::VARCHAR AS value FROM {src} GROUP BY server_id" for n, v, src in (
            ("database_bytes", "sum(size_bytes)::BIGINT", "database_stats"), ("user_tables", "count(*)", "table_stats"),
            ("user_indexes", "count(*)", "index_stats"), ("replicas", "count(*)", "repl_stats"), ("sessions", "count(*)", "activity"))),
    "ck4_production_readiness": READINESS,
    "a15_readiness_score": f"""SELECT *, CASE WHEN failures > 0 THEN 'NOT READY - CRITICAL ISSUES MUST BE RESOLVED'
        WHEN unknown > 0 THEN 'NOT READY - CHECKS WITHOUT DATA' ELSE 'READY FOR PRODUCTION' END AS overall
        FROM (SELECT server_id, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warnings,
              count(*) FILTER (status = 'FAIL') AS failures, count(*) FILTER (status = 'UNKNOWN') AS unknown FROM ({READINESS}) r GROUP BY server_id) x""",
    "ck5_before_after": """WITH b AS (SELECT server_id, queryid, sum(calls)::BIGINT AS calls, sum(total_exec_time) AS t FROM statement_history
            WHERE snap_ts < TIMESTAMP '1999-01-01' GROUP BY ALL),
        a AS (SELECT server_id, queryid, sum(calls)::BIGINT AS calls, sum(total_exec_time) AS t FROM statement_history
            WHERE snap_ts >= TIMESTAMP '1999-01-01' GROUP BY ALL)
        SELECT coalesce(a.server_id, b.server_id) AS server_id, coalesce(a.queryid, b.queryid) AS queryid, b.calls AS calls_before, a.calls AS calls_after,
               a.calls - b.calls AS calls_change, b.t AS total_exec_time_before, a.t AS total_exec_time_after, a.t - b.t AS total_exec_time_change
        FROM b FULL JOIN a ON a.server_id = b.server_id AND a.queryid = b.queryid""",
    "al1_critical_alerts": alerts("AL1"),
    "al2_warning_alerts": alerts("AL2"),
    "al3_monitor_alerts": alerts("AL3"),
    "al4_replication_alerts": alerts("AL4"),
    "al4t_lasting_replication_alerts": lasting("standby_catchup", "CASE WHEN state = 'catchup' THEN 1 ELSE 0 END", "state = 'catchup'", "WARNING", 1800, 7200)
        + " UNION ALL " + lasting("replication_lag_seconds", "replay_lag_s", "replay_lag_s > 30", "MONITOR", 300, 7200),
    "al4g_growing_replication_lag": """SELECT server_id, object, day, samples, latest_lag_s, round(slope, 9) AS slope, 'MONITOR' AS severity FROM (
        SELECT server_id, application_name AS object, strftime(snap_ts, '%Y-%m-%d') AS day, count(*) AS samples, arg_max(replay_lag_s, (snap_ts, sample_id)) AS latest_lag_s,
               regr_slope(replay_lag_s::DOUBLE, (epoch_us(snap_ts) - epoch_us(date_trunc('day', snap_ts))) / 1000000.0) AS slope
        FROM repl_history GROUP BY ALL) d WHERE samples >= 3 AND slope > 0.0001""",
    "al4s_frequent_sync_changes": """SELECT server_id, object, day, changes, 'MONITOR' AS severity FROM (
        SELECT server_id, object, day, count(*) FILTER (sync_state IS DISTINCT FROM previous) AS changes FROM (
            SELECT server_id, application_name AS object, strftime(snap_ts, '%Y-%m-%d') AS day, sync_state, row_number() OVER w AS place, lag(sync_state) OVER w AS previous
            FROM repl_history WINDOW w AS (PARTITION BY server_id, application_name ORDER BY snap_ts, sample_id)) l WHERE place > 1 GROUP BY ALL) d WHERE changes >= 3""",
    "al5_lock_alerts": alerts("AL5"),
    "al6_configured_alerts": alerts("AL6"),
    "al7_scheduled_alerts": alerts("AL7"),
}
