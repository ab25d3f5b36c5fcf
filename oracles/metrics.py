from fleetstat.plans.metrics import DATABASE_COUNTERS
from fleetstat.plans.resources import BGWRITER
from fleetstat.sources.sinks import METRIC_HELP
from oracles.sqltext import clock, pct, r2, top

STATEMENTS = f"({top('SELECT * FROM statements WHERE calls > 100', 50, 'total_exec_time DESC, queryid')}) x"
BASIC = """(SELECT a.*, d.* EXCLUDE (server_id) FROM (SELECT server_id, count(*) AS total, count(*) FILTER (state = 'active') AS active,
    count(*) FILTER (state = 'idle') AS idle FROM activity GROUP BY server_id) a LEFT JOIN (SELECT server_id, sum(size_bytes) AS size_bytes,
    sum(xact_commit) AS xc, sum(xact_rollback) AS xr, sum(blks_read) AS br, sum(blks_hit) AS bh, sum(temp_files) AS tf, sum(temp_bytes) AS tb
    FROM database_stats GROUP BY server_id) d ON d.server_id = a.server_id) b"""
BASIC_VALUES = [
    ("pg_up", "1"), ("pg_connections_total", "total"), ("pg_connections_active", "active"), ("pg_connections_idle", "idle"),
    ("pg_database_size_bytes", "size_bytes"), ("pg_transactions_total", "xc + xr"), ("pg_commits_total", "xc"),
    ("pg_rollbacks_total", "xr"), ("pg_blocks_read_total", "br"), ("pg_blocks_hit_total", "bh"), ("pg_temp_files_total", "tf"),
    ("pg_temp_bytes_total", "tb")]


def rows(source: str, values, labels: str = "''") -> str:
    return " UNION ALL ".join(
        f"SELECT server_id, '{m}' AS metric, {labels} AS labels, ({v})::DOUBLE AS value FROM {source} WHERE ({v}) IS NOT NULL" for m, v in values)


PARTS = {
    "ex1_database_counters": rows("database_stats", [(f"pg_stat_database_{c}", c) for c in DATABASE_COUNTERS], "'datname=' || datname"),
    "ex2_connections_metric": rows("(SELECT server_id, coalesce(state, 'unknown') AS st, count(*) AS n FROM activity GROUP BY ALL) x",
                                   [("pg_stat_activity_connections", "n")], "'state=' || st"),
    "ex3_bgwriter_metric": rows("bgwriter", [(f"pg_stat_bgwriter_{c}", c) for c in BGWRITER]),
    "ex4_locks_metric": rows("(SELECT server_id, mode, count(*) AS n FROM locks GROUP BY ALL) x", [("pg_locks_count", "n")], "'mode=' || mode"),
    "ex5_table_size_metric": rows(f"({top('SELECT * FROM table_stats', 20, 'total_relation_size DESC, relid')}) x",
                                  [("pg_table_size_bytes", "total_relation_size")], "'schema=' || schemaname || ',table=' || table_name"),
    "ex6_replication_lag_metric": rows("repl_stats", [("pg_replication_lag_seconds", "replay_lag_s")],
                                       "'application_name=' || application_name || ',client_addr=' || client_addr"),
    "ex7_statement_metrics": rows(STATEMENTS, [
        ("pg_stat_statements_calls_total", "calls"), ("pg_stat_statements_total_time_seconds", "total_exec_time / 1000"),
        ("pg_stat_statements_mean_time_seconds", r2("mean_exec_time / 1000", 6))], "'queryid=' || queryid"),
    "ex8_basic_metrics": rows(BASIC, BASIC_VALUES),
    "ex9_slow_query_metric": rows(f"({top('SELECT * FROM statements WHERE mean_exec_time > 1000', 10, 'mean_exec_time DESC, queryid')}) x",
                                  [("pg_slow_queries", "calls")], "'query_hash=' || md5(query)"),
}
ALL = " UNION ALL ".join(f"SELECT * FROM ({p}) p{i}" for i, p in enumerate(PARTS.values()))
VALUE = "CASE WHEN value = floor(value) THEN value::DECIMAL(38,0)::VARCHAR ELSE value::DECIMAL(28,6)::VARCHAR END"
# Labels hold no commas or equals signs, so the quoted form follows from the plain one.
QUOTED = """replace(replace(labels, '=', '="'), ',', '",') || '"'"""
HELP = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, _, t in METRIC_HELP) + " ELSE metric END"
TYPE = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{k}'" for m, k, _ in METRIC_HELP) + " ELSE 'untyped' END"

SQL = {
    **PARTS,
    "s3_metrics_long": ALL,
    "s4_prometheus_lines": f"""SELECT DISTINCT server_id, metric, 0 AS part, '# HELP ' || metric || ' ' || {HELP} AS line FROM ({ALL}) a
        UNION ALL SELECT DISTINCT server_id, metric, 1, '# TYPE ' || metric || ' ' || {TYPE} FROM ({ALL}) a
        UNION ALL SELECT server_id, metric, 2, metric || CASE WHEN labels = '' THEN '' ELSE '{{' || {QUOTED} || '}}' END || ' ' || {VALUE} FROM ({ALL}) a""",
    "s5_influx_lines": f"""SELECT a.server_id, 'postgresql,host=' || coalesce(host, 'localhost') || ',database=postgres' || CASE WHEN labels = '' THEN '' ELSE ',' || replace(labels, ' ', chr(92) || ' ') END
        || ' ' || metric || '=' || {VALUE} || ' 1706659200000000000' AS line FROM ({ALL}) a LEFT JOIN servers v ON v.server_id = a.server_id""",
    "s6_metrics_json": f"""SELECT a.server_id, host, port::VARCHAR AS port, '2024-01-31T00:00:00Z' AS timestamp,
        string_agg(metric || '=' || value::DECIMAL(38,0)::VARCHAR, ';' ORDER BY metric) AS metrics_in_order
        FROM ({rows(BASIC, BASIC_VALUES)}) a JOIN servers v ON v.server_id = a.server_id GROUP BY a.server_id, host, port""",
    "s9_retention_summary": f"""SELECT tier, count(*) AS snapshots, sum(size_bytes)::BIGINT AS bytes, {pct('sum(size_bytes)', '104857600')} AS megabytes,
        {clock('min(snap_ts)')} AS oldest, {clock('max(snap_ts)')} AS newest FROM (SELECT *, CASE WHEN days > 30 THEN 'DELETE' WHEN days > 7 THEN 'COMPRESS'
        ELSE 'KEEP' END AS tier FROM (SELECT *, date_diff('day', snap_ts, (SELECT max(snap_ts) FROM stored_snapshots)) AS days FROM stored_snapshots) x) y GROUP BY tier""",
}
