from fleetstat.plans import config as C
from oracles.sqltext import age_s, pretty, unit_bytes

VALUES = f"(SELECT *, TRY_CAST(setting AS DOUBLE) AS num, {unit_bytes()} AS bytes_value FROM settings) x"


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def assess(where: str, ladder) -> str:
    return f"""SELECT server_id, name AS parameter, setting AS current_value, unit, source, short_desc AS description,
        replace({ladder.sql()}, '=', coalesce(setting, '')) AS assessment FROM {VALUES} WHERE {where}"""


def pick(position: int) -> str:
    rungs = " ".join(f"WHEN '{n}' THEN {v[position]}" for n, v in C.WORKLOADS.items())
    return f"(CASE workload {rungs} END)"


FACTS = f"""(SELECT p.*, {unit_bytes('sb', "'8kB'")} AS buffers, coalesce(n, 0) AS statement_extensions FROM (
    SELECT server_id, max(setting) FILTER (name = 'shared_buffers') AS sb, max(setting) FILTER (name = 'max_connections')::BIGINT AS connections,
           max(setting) FILTER (name = 'fsync') AS fsync, max(setting) FILTER (name = 'autovacuum') AS autovacuum FROM settings GROUP BY server_id) p
    LEFT JOIN (SELECT server_id, count(*) AS n FROM extensions WHERE extname = 'pg_stat_statements' GROUP BY server_id) e ON e.server_id = p.server_id) f"""
TUNED = f"""(SELECT server_id, workload, greatest(4, least(512, ram_mb // {pick(1)} // 4)) AS work_mb, ram_mb * {pick(0)} // 100 AS buffers_mb,
    greatest(64, least(2048, ram_mb * 8 // 100)) AS maintenance_mb, ram_mb * {pick(2)} // 100 AS cache_mb, {pick(1)} AS connections
    FROM (SELECT server_id, workload, (CASE WHEN ram_bytes > 0 THEN ram_bytes ELSE 8589934592 END // 1073741824) * 1024 AS ram_mb FROM servers) r) t"""


def line(category: str, text: str) -> str:
    return f"SELECT server_id, '{C.ADVICE_TITLES[category]}' AS category, {text} AS recommendation FROM {FACTS}"


def recommended() -> str:
    rows = [f"SELECT server_id, '{n}' AS name, {c} || 'MB' AS recommended FROM {TUNED}" for n, c in (
        ("shared_buffers", "buffers_mb"), ("work_mem", "work_mb"), ("maintenance_work_mem", "maintenance_mb"), ("effective_cache_size", "cache_mb"))]
    rows.append(f"SELECT server_id, 'max_connections', connections::VARCHAR FROM {TUNED}")
    for workload, name, value in C.LISTED_TUNING:
        rows.append(f"SELECT server_id, '{name}', '{value}' FROM servers" + (f" WHERE workload = '{workload}'" if workload else ""))
    return " UNION ALL ".join(rows)


SQL = {
    "ca1_server_info": f"""SELECT v.server_id, version AS postgresql_version, n.setting::BIGINT AS version_number, d.setting AS data_directory,
        c.setting AS config_file, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS server_start_time, {age_s('started_at')} // 3600 AS uptime_hours
        FROM servers v LEFT JOIN settings n ON n.server_id = v.server_id AND n.name = 'server_version_num'
        LEFT JOIN settings d ON d.server_id = v.server_id AND d.name = 'data_directory'
        LEFT JOIN settings c ON c.server_id = v.server_id AND c.name = 'config_file'""",
    "ca2_memory_assessment": f"""SELECT server_id, name AS parameter, setting || coalesce(' ' || unit, '') AS current_value, bytes_value,
        {pretty('bytes_value')} AS size_pretty, source AS config_source, short_desc AS description, {C.MEMORY.sql()} AS assessment
        FROM {VALUES} WHERE name IN ({quoted(C.MEMORY_NAMES)})""",
    "ca3_concurrency_assessment": assess(f"name IN ({quoted(C.CONCURRENCY_NAMES)})", C.CONCURRENCY),
    "ca4_durability_assessment": assess(f"name IN ({quoted(C.DURABILITY_NAMES)})", C.DURABILITY),
    "ca5_planner_assessment": assess(f"name IN ({quoted(C.PLANNER_NAMES)})", C.PLANNER),
    "ca6_logging_assessment": assess(f"name IN ({quoted(C.LOGGING_NAMES)})", C.LOGGING),
    "ca7_autovacuum_assessment": assess("name LIKE 'autovacuum%'", C.AUTOVACUUM),
    "ca8_extension_features": f"""SELECT server_id, extname AS extension_name, extversion AS version, schemaname AS schema,
        {C.EXTENSION_USE.sql()} AS description FROM extensions""",
    "ca9_security_settings": assess(f"name IN ({quoted(C.SECURITY_NAMES)})", C.SECURITY),
    "ca10_configuration_advice": " UNION ALL ".join([
        line("memory", f"""CASE WHEN buffers < 134217728 THEN 'shared_buffers too low - recommend 25% of RAM (current: ' || {pretty('buffers')} || ')'
             WHEN buffers > 8589934592 THEN 'shared_buffers very high - may cause performance issues (current: ' || {pretty('buffers')} || ')'
             ELSE 'shared_buffers appears reasonable' END"""),
        line("connection", """CASE WHEN connections > 1000 THEN 'max_connections very high (' || connections || ') - strongly recommend connection pooling'
             WHEN connections > 200 THEN 'max_connections high (' || connections || ') - consider connection pooling'
             ELSE 'max_connections appears reasonable (' || connections || ')' END"""),
        line("durability", C.DURABILITY_ADVICE.sql()), line("maintenance", C.MAINTENANCE_ADVICE.sql()),
        line("monitoring", C.MONITORING_ADVICE.sql())]),
    "es1_server_metadata": "SELECT server_id, host, port, version, '2024-01-31 00:00:00' AS exported_at FROM servers",
    "es2_all_settings": """SELECT server_id, category, name, setting, unit, short_desc, context, vartype, source, boot_val, pending_restart FROM settings""",
    "es3_overridden_settings": """SELECT server_id, category, name, setting, unit, boot_val, source, pending_restart FROM settings WHERE source <> 'default'""",
    "es4_settings_document": """SELECT server_id, count(*) AS setting_count,
        string_agg(name || '=' || setting, ';' ORDER BY category, name) AS settings_in_order FROM settings GROUP BY server_id""",
    "pt1_recommend_settings": recommended(),
    "pt2_settings_drift": f"""SELECT r.server_id, r.name, x.setting || coalesce(x.unit, '') AS current_value, recommended, source,
        {C.DRIFT.sql().replace("name =", "x.name =")} AS note FROM ({recommended()}) r LEFT JOIN {VALUES} ON x.server_id = r.server_id AND x.name = r.name""",
}
