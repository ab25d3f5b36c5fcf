"""Telemetry relations derived from the shared test tables.

Each relation is one SELECT over the test tables, so its size follows theirs.
The text is produced for a SQL dialect: Spark runs it to feed the reports, and
the side-by-side checks print the same rows for their own engine.
See FIXTURES.md for the meaning of the arithmetic.
"""

from __future__ import annotations

from functools import lru_cache

AS_OF = "2024-01-31 00:00:00"
SETTING_ABSENT = "~"

# Fixed values: (name, unit, category, vartype, values taken in turn by the servers).
SETTINGS: list[tuple[str, str | None, str, str, str]] = [
    ("shared_buffers", "8kB", "Memory", "integer", "8192|16384|524288|2097152"),
    ("work_mem", "kB", "Memory", "integer", "1024|4096|65536|2097152"),
    ("maintenance_work_mem", "kB", "Memory", "integer", "32768|65536|1048576|4194304"),
    ("effective_cache_size", "8kB", "Memory", "integer", "65536|131072|524288"),
    ("wal_buffers", "8kB", "Memory", "integer", "512|2048"),
    ("max_connections", None, "Connections", "integer", "10|100|300|2000|5000"),
    ("shared_preload_libraries", None, "Libraries", "string", "|pg_stat_statements"),
    ("max_worker_processes", None, "Workers", "integer", "4|8|128"),
    ("max_parallel_workers", None, "Workers", "integer", "8|16"),
    ("max_parallel_workers_per_gather", None, "Workers", "integer", "0|2|16"),
    ("max_parallel_maintenance_workers", None, "Workers", "integer", "2|4"),
    ("wal_level", None, "Durability", "enum", "minimal|replica|logical|odd"),
    ("fsync", None, "Durability", "bool", "on|off|odd"),
    ("synchronous_commit", None, "Durability", "enum", "on|off|local|remote_apply"),
    ("wal_sync_method", None, "Durability", "enum", "fdatasync|open_sync"),
    ("checkpoint_completion_target", None, "Durability", "real", "0.3|0.5|0.9|0.95"),
    ("checkpoint_timeout", "s", "Durability", "integer", "300|3600"),
    ("max_wal_size", "MB", "Durability", "integer", "512|1024|4096|204800"),
    ("min_wal_size", "MB", "Durability", "integer", "80|1024"),
    ("wal_keep_size", "MB", "Durability", "integer", "0|512|2048"),
    ("wal_compression", None, "Durability", "enum", "on|off"),
    ("archive_mode", None, "Archiving", "enum", "on|off|always"),
    ("archive_command", None, "Archiving", "string", "|/bin/true|cp %p /archive/%f"),
    ("archive_timeout", "s", "Archiving", "integer", "0|7200|300"),
    ("random_page_cost", None, "Planner", "real", "4|1.1|8|3"),
    ("seq_page_cost", None, "Planner", "real", "1|1.5"),
    ("cpu_tuple_cost", None, "Planner", "real", "0.01|0.02"),
    ("cpu_index_tuple_cost", None, "Planner", "real", "0.005|0.01"),
    ("cpu_operator_cost", None, "Planner", "real", "0.0025|0.005"),
    ("effective_io_concurrency", None, "Planner", "integer", "1|200|2000"),
    ("default_statistics_target", None, "Planner", "integer", "50|100|5000"),
    ("constraint_exclusion", None, "Planner", "enum", "off|on|partition|odd"),
    ("enable_seqscan", None, "Planner", "bool", "on|off"),
    ("enable_indexscan", None, "Planner", "bool", "on|off"),
    ("logging_collector", None, "Logging", "bool", "on|off"),
    ("log_destination", None, "Logging", "string", "stderr|csvlog"),
    ("log_statement", None, "Logging", "enum", "none|ddl|mod|all|odd"),
    ("log_min_duration_statement", "ms", "Logging", "integer", "-1|0|20000|250"),
    ("log_checkpoints", None, "Logging", "bool", "on|off|odd"),
    ("log_connections", None, "Logging", "bool", "on|off"),
    ("log_disconnections", None, "Logging", "bool", "on|off"),
    ("log_lock_waits", None, "Logging", "bool", "off|on"),
    ("log_temp_files", "kB", "Logging", "integer", "-1|0"),
    ("log_autovacuum_min_duration", "ms", "Logging", "integer", "600000|-1"),
    ("autovacuum", None, "Autovacuum", "bool", "on|off|odd"),
    ("autovacuum_max_workers", None, "Autovacuum", "integer", "2|3|20"),
    ("autovacuum_vacuum_threshold", None, "Autovacuum", "integer", "50|500"),
    ("autovacuum_vacuum_scale_factor", None, "Autovacuum", "real", "0.05|0.2|0.5"),
    ("autovacuum_naptime", "s", "Autovacuum", "integer", "60|15"),
    ("autovacuum_freeze_max_age", None, "Autovacuum", "integer", "200000000|1000000000"),
    ("vacuum_freeze_table_age", None, "Autovacuum", "integer", "150000000|100000000"),
    ("vacuum_cost_delay", "ms", "Autovacuum", "real", "0|2"),
    ("vacuum_cost_limit", None, "Autovacuum", "integer", "200|2000"),
    ("ssl", None, "Security", "bool", "on|off|odd"),
    ("password_encryption", None, "Security", "enum", "scram-sha-256|md5|plain"),
    ("row_security", None, "Security", "bool", "on|off|odd"),
    ("log_statement_stats", None, "Statistics", "bool", "off|on"),
    ("track_activities", None, "Statistics", "bool", "on|off"),
    ("track_counts", None, "Statistics", "bool", "on|off"),
    ("track_io_timing", None, "Statistics", "bool", "off|on"),
    ("track_functions", None, "Statistics", "enum", "none|pl"),
    ("server_version_num", None, "Preset", "integer", "150004|160002"),
    ("data_directory", None, "Files", "string", "/data/a|/data/b"),
    ("config_file", None, "Files", "string", "/etc/a.conf|/etc/b.conf"),
]

# Fixed values: (extension, version, description) offered to every server.
EXTENSIONS = [
    ("pg_stat_statements", "1.10", "statement statistics"),
    ("pg_buffercache", "1.4", "shared buffer inspection"),
    ("pgstattuple", "1.5", "tuple statistics"),
    ("adminpack", "2.1", "server file functions"),
    ("plpgsql", "1.0", "procedural language"),
    ("postgres_fdw", "1.1", "tables of other servers"),
    ("dblink", "1.2", "connections to other databases"),
    ("file_fdw", "1.0", "server-side file access"),
]


class Dialect:
    """The few spellings that differ between the two engines."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def div(self, a, b):
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def seconds_later(self, ts, n):
        if self.spark:
            return f"timestampadd(SECOND, CAST({n} AS INT), {ts})"
        return f"({ts} + to_seconds(CAST({n} AS BIGINT)))"

    def days_before(self, n):
        return self.seconds_later(f"TIMESTAMP '{AS_OF}'", f"-86400 * ({n})")

    def hexword(self, n):
        return f"hex({n})" if self.spark else f"printf('%X', {n})"

    def array(self, *items):
        body = ", ".join(items)
        return f"array({body})" if self.spark else f"[{body}]"

    def numbers(self, n):
        """[1..n]; NULL when n is 0."""
        body = f"sequence(1, {n})" if self.spark else f"list_transform(range(1, {n} + 1), lambda x: CAST(x AS INT))"
        return f"CASE WHEN {n} > 0 THEN {body} END"

    def texts(self, n):
        """['1'..'n']; NULL when n is 0."""
        if self.spark:
            body = f"transform(sequence(1, {n}), x -> CAST(x AS STRING))"
        else:
            body = f"list_transform(range(1, {n} + 1), lambda x: CAST(x AS VARCHAR))"
        return f"CASE WHEN {n} > 0 THEN {body} END"

    def each(self, source, items, alias):
        if self.spark:
            return f"{source} LATERAL VIEW explode({items}) t AS {alias}"
        return f"{source}, unnest({items}) AS t({alias})"

    def record(self, **fields):
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def nth(self, text, position):
        """Zero-based word of a '|'-separated text."""
        if self.spark:
            return f"element_at(split({text}, '[|]'), CAST(1 + {position} AS INT))"
        return f"string_split({text}, '|')[1 + {position}]"


def _pick(expr: str, *values: str) -> str:
    """One of the values by position; the last one is the default."""
    rungs = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"(CASE {expr} {rungs} ELSE {values[-1]} END)"


def _words(expr: str, *values: str) -> str:
    return _pick(expr, *[f"'{v}'" for v in values])


def _lit(value) -> str:
    return "CAST(NULL AS VARCHAR(20))" if value is None else "'" + value.replace("'", "''") + "'"


@lru_cache(maxsize=None)
def definitions(dialect: str) -> dict[str, str]:
    d = Dialect(dialect)
    snap = f"TIMESTAMP '{AS_OF}' AS snap_ts"
    out: dict[str, str] = {}

    out["activity"] = f"""
        SELECT event_id % 4 AS server_id, {snap}, event_id AS pid,
               'db' || CAST(user_id % 6 AS VARCHAR(9)) AS datname,
               'u' || CAST(user_id % 25 AS VARCHAR(9)) AS usename,
               CASE WHEN event_id % 17 <> 0 THEN 'app' || CAST(event_id % 12 AS VARCHAR(9)) END AS application_name,
               '10.0.0.' || CAST(user_id % 20 AS VARCHAR(9)) AS client_addr,
               {_words("event_id % 20", "autovacuum worker", "checkpointer", "walwriter", "client backend")} AS backend_type,
               CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_type = 'view' THEN 'idle'
                    WHEN event_type = 'signup' THEN 'idle in transaction'
                    WHEN event_type = 'error' THEN 'idle in transaction (aborted)' ELSE 'active' END AS state,
               {_pick("event_id % 10", "'IO'", "'IO'", "'Lock'", "'Lock'", "'LWLock'", "'Client'", "'IO'", "'BufferPin'", "NULL")} AS wait_event_type,
               {_pick("event_id % 10", "'DataFileRead'", "'WALWrite'", "'relation'", "'tuple'", "'BufferMapping'", "'ClientRead'", "'WALSync'", "'BufferPin'", "NULL")} AS wait_event,
               CAST(ts AS TIMESTAMP) AS query_start, CAST(ts AS TIMESTAMP) AS xact_start,
               {d.seconds_later("CAST(ts AS TIMESTAMP)", "-(event_id % 7200)")} AS backend_start,
               {d.seconds_later("CAST(ts AS TIMESTAMP)", "event_id % 600")} AS state_change,
               {_words("event_id % 9", "autovacuum: VACUUM t", "ALTER TABLE t ADD c int", "update t set x = $1",
                       "INSERT INTO t VALUES ($1,$2)", "DELETE FROM t", "CREATE TABLE z()", "retry after deadlock",
                       "SELECT * FROM t WHERE id = $1")} AS query,
               event_id % 997 = 0 AS is_collector
        FROM events"""

    out["statements"] = f"""
        SELECT queryid % 4 AS server_id, {snap}, queryid,
               {_words("queryid % 7", "SELECT a FROM t WHERE b = $1", "insert into t values ($1)", "UPDATE t SET a = $1",
                       "Delete from t", "CREATE TABLE x()", "ALTER TABLE x ADD y int", "VACUUM t")}
                 || CASE WHEN queryid % 19 = 0 THEN ' /* pg_stat_activity */' ELSE '' END
                 || ' -- ' || CAST(queryid AS VARCHAR(19)) AS query,
               calls, qty * weight AS rows, CAST(total AS DOUBLE) AS total_exec_time,
               CAST(total AS DOUBLE) / CAST(calls AS DOUBLE) AS mean_exec_time,
               CAST(low AS DOUBLE) AS min_exec_time, CAST(high AS DOUBLE) AS max_exec_time,
               sqrt(greatest(CAST(calls AS DOUBLE) * CAST(squares AS DOUBLE) - CAST(total AS DOUBLE) * CAST(total AS DOUBLE), 0.0))
                 / CAST(calls AS DOUBLE) AS stddev_exec_time,
               CAST(lines AS DOUBLE) AS total_plan_time, CAST(lines AS DOUBLE) / CAST(calls AS DOUBLE) AS mean_plan_time,
               qty * (queryid % 40) AS shared_blks_hit, lines * (queryid % 25) AS shared_blks_read,
               flag_a AS shared_blks_written, flag_r AS shared_blks_dirtied,
               flag_n AS local_blks_read, flag_n * 0 AS local_blks_written,
               CASE WHEN queryid % 6 = 0 THEN lines * 200 ELSE 0 END AS temp_blks_read,
               CASE WHEN queryid % 6 = 0 THEN lines * 200 ELSE 0 END AS temp_blks_written,
               CASE WHEN queryid % 4 = 0 THEN calls ELSE 0 END AS wal_records,
               CASE WHEN queryid % 4 = 0 THEN {d.div("calls", "10")} ELSE 0 END AS wal_fpi,
               CASE WHEN queryid % 4 = 0 THEN xsum * 1000 ELSE 0 END AS wal_bytes,
               CASE WHEN queryid % 11 = 0 THEN calls ELSE 0 END AS jit_functions,
               CASE WHEN queryid % 11 = 0 THEN CAST(lines AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS jit_generation_time,
               CASE WHEN queryid % 11 = 0 THEN calls ELSE 0 END AS jit_inlining_count,
               CASE WHEN queryid % 11 = 0 THEN CAST(lines * 2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS jit_inlining_time,
               CASE WHEN queryid % 11 = 0 THEN calls ELSE 0 END AS jit_optimization_count,
               CASE WHEN queryid % 11 = 0 THEN CAST(lines * 3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS jit_optimization_time,
               CASE WHEN queryid % 11 = 0 THEN calls ELSE 0 END AS jit_emission_count,
               CASE WHEN queryid % 11 = 0 THEN CAST(lines * 4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS jit_emission_time
        FROM (SELECT queryid, max(weight) AS weight, CAST(count(*) * max(weight) AS BIGINT) AS calls,
                     CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(ln) AS BIGINT) AS lines, CAST(sum(x) AS BIGINT) AS xsum,
                     CAST(sum(ms) * max(weight) AS BIGINT) AS total, CAST(sum(ms * ms) * max(weight) AS BIGINT) AS squares,
                     min(ms) AS low, max(ms) AS high,
                     CAST(sum(CASE WHEN rf = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS flag_a,
                     CAST(sum(CASE WHEN rf = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS flag_r,
                     CAST(sum(CASE WHEN rf = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS flag_n
              FROM (SELECT *, CASE queryid % 5 WHEN 0 THEN (CASE WHEN ln = 7 THEN x ELSE x % 50 END) WHEN 1 THEN x % 900
                                   WHEN 2 THEN x + 4000 ELSE x END AS ms,
                           CAST({_pick("queryid % 6", "1", "2", "3", "5", "1", "40")} AS BIGINT) AS weight
                    FROM (SELECT l_partkey AS queryid, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS qty,
                                 CAST(round(l_extendedprice * 100) AS BIGINT) % 7919 AS x, l_returnflag AS rf
                          FROM lineitem) raw) lines
              GROUP BY queryid) grouped"""

    out["locks"] = f"""
        SELECT l_orderkey % 4 AS server_id, {snap}, l_orderkey AS pid,
               CASE WHEN l_linenumber <= 5 THEN 'relation' ELSE 'transactionid' END AS locktype,
               CASE WHEN l_linenumber <= 5 THEN l_suppkey % 6 END AS database,
               CASE WHEN l_linenumber <= 5 THEN l_partkey END AS relation,
               CASE WHEN l_linenumber > 5 THEN l_partkey END AS transactionid,
               CASE WHEN l_linenumber <= 5 AND l_partkey % 3 = 0 THEN {d.div("l_orderkey", "4")} % 2 END AS page,
               CASE WHEN l_linenumber <= 5 AND l_partkey % 3 = 0 THEN {d.div("l_orderkey", "8")} % 2 END AS tuple,
               CAST(NULL AS VARCHAR(20)) AS virtualxid, CAST(NULL AS BIGINT) AS classid,
               CASE WHEN l_linenumber <= 5 AND l_partkey % 5 = 0 THEN {d.div("l_orderkey", "16")} % 2 END AS objid,
               CAST(NULL AS BIGINT) AS objsubid,
               {_words("l_linenumber - 1", "AccessShareLock", "RowShareLock", "RowExclusiveLock", "ShareUpdateExclusiveLock",
                       "ShareLock", "ExclusiveLock", "AccessExclusiveLock")} AS mode,
               l_linenumber <> 1 AS granted
        FROM lineitem"""

    names = """replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR(19))"""
    table_name = f"CASE WHEN p_partkey % 10 = 0 THEN 'user_' ELSE '' END || {names}"
    out["table_stats"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, p_partkey AS relid, lower(p_type) AS schemaname, {table_name} AS table_name,
               live AS n_live_tup, {d.div("live * (p_partkey % 70)", "100")} AS n_dead_tup,
               lines * 50 AS n_tup_ins, n * 20 AS n_tup_upd, n AS n_tup_del,
               {d.div("n * 20 * (p_partkey % 101)", "100")} AS n_tup_hot_upd,
               (p_partkey * 7) % 2500 AS seq_scan, {d.div("((p_partkey * 7) % 2500) * live", "3")} AS seq_tup_read,
               CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 13) % 3000 END AS idx_scan,
               CASE WHEN p_partkey % 11 <> 0 THEN ((p_partkey * 13) % 3000) * 5 END AS idx_tup_fetch,
               CASE WHEN p_partkey % 9 <> 0 THEN {d.days_before("p_partkey % 45")} END AS last_vacuum,
               CASE WHEN p_partkey % 7 <> 0 THEN {d.days_before("p_partkey % 20")} END AS last_autovacuum,
               CASE WHEN p_partkey % 8 <> 0 THEN {d.days_before("p_partkey % 60")} END AS last_analyze,
               CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 3 <> 0 THEN {d.days_before("p_partkey % 50")} END AS last_autoanalyze,
               live * 100 * size_class AS relation_size,
               live * 100 * size_class + {d.div("live * 100 * size_class * (p_partkey % 5)", "4")} AS total_relation_size,
               (p_partkey * 1048573) % 2200000000 AS xid_age,
               lines * (p_partkey % 9) AS heap_blks_read, qty * (p_partkey % 23) AS heap_blks_hit,
               n * (p_partkey % 4) AS idx_blks_read, n * (p_partkey % 15) AS idx_blks_hit,
               CASE WHEN p_partkey % 6 = 0 THEN {d.array("'fillfactor=90'", "'autovacuum_enabled=true'")} END AS reloptions
        FROM (SELECT p.*, g.n, g.lines, g.qty, g.qty * p_size AS live,
                     CAST(p_size AS BIGINT) * (p_partkey % 50 + 1) AS size_class
              FROM part p JOIN (SELECT l_partkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines,
                                       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
                                FROM lineitem GROUP BY l_partkey) g ON p.p_partkey = g.l_partkey) x"""

    out["index_stats"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, p_partkey AS relid, lower(p_type) AS schemaname, {table_name} AS table_name,
               'idx_' || CAST(p_partkey AS VARCHAR(19)) || '_' || CAST(k AS VARCHAR(9)) AS index_name,
               {d.numbers("(CASE WHEN k = 3 AND p_partkey % 4 = 0 THEN 2 ELSE k END)")} AS indkey,
               (p_partkey * k) % 120 AS idx_scan, ((p_partkey * k) % 120) * (p_partkey % 25) AS idx_tup_read,
               ((p_partkey * k) % 120) * 2 AS idx_tup_fetch, CAST(p_size AS BIGINT) * k * 1048576 AS index_size,
               'CREATE INDEX idx_' || CAST(p_partkey AS VARCHAR(19)) || '_' || CAST(k AS VARCHAR(9)) || ' ON '
                 || lower(p_type) || '.' || {table_name} || ' ('
                 || {_words("(CASE WHEN k = 3 AND p_partkey % 4 = 0 THEN 2 ELSE k END) - 1", "col_1", "col_1, col_2", "col_1, col_2, col_3")}
                 || ')' AS indexdef
        FROM {d.each("part", d.array("1", "2", "3"), "k")}"""

    out["database_stats"] = f"""
        SELECT CAST(n_nationkey % 4 AS BIGINT) AS server_id, {snap}, n_name AS datname, CAST(n_nationkey AS BIGINT) AS datid,
               CAST(n_nationkey % 9 AS BIGINT) AS numbackends, f AS xact_commit, p AS xact_rollback,
               hit AS blks_hit, n * (n_nationkey % 12) AS blks_read,
               p1 AS tup_returned, p2 AS tup_fetched, p3 AS tup_inserted, p4 AS tup_updated, p5 AS tup_deleted,
               CAST(n_nationkey % 3 AS BIGINT) AS deadlocks, CAST(n_nationkey % 5 AS BIGINT) AS temp_files,
               CAST(n_nationkey AS BIGINT) * 7000000 AS temp_bytes,
               {d.days_before("n_nationkey % 90")} AS stats_reset,
               CAST(n_nationkey AS BIGINT) * n_nationkey * 1000000000 AS size_bytes,
               CAST(n_nationkey AS BIGINT) * 80000000 AS xid_age, n_nationkey % 12 = 11 AS datistemplate,
               CAST(n_nationkey AS BIGINT) AS datdba,
               CASE WHEN n_nationkey % 3 = 0 THEN '{{role_' || CAST(n_nationkey AS VARCHAR(9)) || '=CTc/owner}}' END AS datacl
        FROM (SELECT n_nationkey, n_name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(f) AS BIGINT) AS f, CAST(sum(p) AS BIGINT) AS p,
                     CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(p1) AS BIGINT) AS p1, CAST(sum(p2) AS BIGINT) AS p2,
                     CAST(sum(p3) AS BIGINT) AS p3, CAST(sum(p4) AS BIGINT) AS p4, CAST(sum(p5) AS BIGINT) AS p5
              FROM (SELECT n_nationkey, n_name,
                           CASE WHEN live THEN 1 ELSE 0 END AS n,
                           CASE WHEN live AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS f,
                           CASE WHEN live AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS p,
                           CASE WHEN live THEN o_orderkey % 1000 ELSE 0 END AS hit,
                           CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS p1,
                           CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS p2,
                           CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS p3,
                           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS p4,
                           CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS p5
                    FROM (SELECT *, n_nationkey <> 24 AS live FROM nation
                          LEFT JOIN customer ON c_nationkey = n_nationkey
                          LEFT JOIN orders ON o_custkey = c_custkey) w) v
              GROUP BY n_nationkey, n_name) u"""

    catalogue = d.array(*[
        d.record(j=str(j), name=_lit(n), unit=_lit(u), category=_lit(c), vartype=_lit(v),
                 vals=_lit(vals), n=str(vals.count("|") + 1))
        for j, (n, u, c, v, vals) in enumerate(SETTINGS)
    ])
    value = d.nth("k.vals", "(c_custkey + k.j) % k.n")
    out["settings"] = f"""
        SELECT c_custkey AS server_id, {snap}, k.name AS name, {value} AS setting,
               k.unit AS unit, k.category AS category, 'meaning of ' || k.name AS short_desc,
               CASE WHEN k.j % 3 = 0 THEN 'postmaster' ELSE 'user' END AS context, k.vartype AS vartype,
               {_words("(c_custkey + k.j * 3) % 5", "default", "override", "configuration file", "default")} AS source,
               {d.nth("k.vals", "0")} AS boot_val, (c_custkey + k.j) % 40 = 0 AS pending_restart
        FROM {d.each("customer", catalogue, "k")}"""

    lsn = lambda n: f"({d.hexword(d.div(n, '4294967296'))} || '/' || {d.hexword(f'({n}) % 4294967296')})"
    now_bytes = "(c_custkey % 100 + 200) * 500000000 + c_custkey * 8192"
    out["servers"] = f"""
        SELECT c_custkey AS server_id, {snap}, 'host' || CAST(c_custkey AS VARCHAR(19)) AS host, 5432 AS port,
               'PostgreSQL ' || {_words("c_custkey % 2", "15.4", "16.2")} AS version,
               {d.seconds_later(f"TIMESTAMP '{AS_OF}'", "-(c_custkey * 997)")} AS started_at,
               c_custkey % 10 = 9 AS in_recovery, {lsn(now_bytes)} AS current_lsn,
               {lsn(f"{now_bytes} - (c_custkey % 7) * 1000000")} AS checkpoint_lsn,
               {lsn(f"{now_bytes} - (c_custkey % 7) * 1000000 - (c_custkey % 11) * 3000000")} AS redo_lsn,
               CASE WHEN c_custkey % 10 = 9 THEN {d.seconds_later(f"TIMESTAMP '{AS_OF}'", "-(c_custkey % 900)")} END AS last_replay_ts,
               CAST(c_custkey % 33 AS BIGINT) * 1073741824 AS ram_bytes,
               {_words("c_custkey % 4", "oltp", "olap", "web", "mixed")} AS workload,
               CAST((c_custkey % 33) * 1000000000 AS BIGINT) AS disk_bytes
        FROM customer"""

    out["archiver"] = f"""
        SELECT c_custkey AS server_id, {snap}, c_custkey * 3 AS archived_count,
               '0000000100000000' || lpad({d.hexword("c_custkey % 65536")}, 8, '0') AS last_archived_wal,
               CASE WHEN c_custkey % 6 <> 5 THEN {d.seconds_later(f"TIMESTAMP '{AS_OF}'", "-((c_custkey % 50) * 120)")} END AS last_archived_time,
               c_custkey % 4 AS failed_count,
               CASE WHEN c_custkey % 4 <> 0 THEN '0000000200000000' || lpad({d.hexword("c_custkey % 65536")}, 8, '0') END AS last_failed_wal,
               CASE WHEN c_custkey % 4 <> 0 THEN {d.seconds_later(f"TIMESTAMP '{AS_OF}'", "-((c_custkey % 60) * 3600)")} END AS last_failed_time,
               {d.days_before("c_custkey % 90")} AS stats_reset
        FROM customer"""

    out["bgwriter"] = f"""
        SELECT c_custkey AS server_id, {snap}, (c_custkey % 500) * 10 AS checkpoints_timed, (c_custkey * 3) % 700 AS checkpoints_req,
               c_custkey * 11 AS checkpoint_write_time, c_custkey * 2 AS checkpoint_sync_time, c_custkey * 40 AS buffers_checkpoint,
               c_custkey * 5 AS buffers_clean, c_custkey % 1000 AS buffers_backend
        FROM customer"""

    slot_at = "(s_suppkey % 4 + 200) * 500000000 + (s_suppkey % 4) * 8192 - (s_suppkey % 97) * 180000000"
    out["repl_slots"] = f"""
        SELECT s_suppkey % 4 AS server_id, {snap}, 'slot_' || CAST(s_suppkey AS VARCHAR(19)) AS slot_name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'physical' ELSE 'logical' END AS slot_type,
               CASE WHEN s_suppkey % 2 = 1 THEN 'pgoutput' END AS plugin, 'db' || CAST(s_suppkey % 6 AS VARCHAR(9)) AS database,
               s_suppkey % 3 <> 0 AS active,
               CASE WHEN s_suppkey % 13 <> 12 THEN {lsn(slot_at)} END AS restart_lsn,
               CASE WHEN s_suppkey % 13 <> 12 THEN {lsn(f"{slot_at} + 4096")} END AS confirmed_flush_lsn
        FROM supplier"""

    out["repl_stats"] = f"""
        SELECT s_suppkey % 4 AS server_id, {snap}, s_suppkey AS pid, 'standby_' || CAST(s_suppkey AS VARCHAR(19)) AS application_name,
               '10.1.0.' || CAST(s_suppkey % 250 AS VARCHAR(9)) AS client_addr,
               {_words("s_suppkey % 5", "catchup", "streaming")} AS state, {_words("s_suppkey % 3", "sync", "async", "potential")} AS sync_state,
               {lsn(f"{slot_at} + 3000")} AS sent_lsn, {lsn(f"{slot_at} + 2000")} AS write_lsn,
               {lsn(f"{slot_at} + 1000")} AS flush_lsn, {lsn(slot_at)} AS replay_lsn,
               CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 300 END AS write_lag_s,
               CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 600 END AS flush_lag_s,
               CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 900 END AS replay_lag_s
        FROM supplier"""

    out["column_stats"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, p_partkey AS relid,
               CASE WHEN p_partkey % 50 = 49 THEN 'pg_catalog' ELSE lower(p_type) END AS schemaname,
               {table_name} AS table_name, 'col_' || CAST(k AS VARCHAR(9)) AS attname,
               CAST((p_partkey * k) % 10 AS DOUBLE) / 10.0 AS null_frac,
               CASE WHEN p_partkey % 7 = k THEN -1.0 ELSE CAST((p_partkey * k * 37) % 3000 AS DOUBLE) END AS n_distinct,
               (p_partkey * k) % 1500 AS avg_width,
               {d.texts("CAST((p_partkey + k) % 30 AS INT)")} AS most_common_vals,
               {d.texts("CAST((p_partkey * 3 + k) % 80 AS INT)")} AS histogram_bounds,
               CAST((p_partkey * k) % 200 - 100 AS DOUBLE) / 100.0 AS correlation,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 3) * 50 ELSE -1 END AS BIGINT) AS attstattarget
        FROM {d.each("part", d.array("1", "2", "3", "4"), "k")}"""

    out["ext_stats"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, p_partkey AS relid, lower(p_type) AS schemaname, {table_name} AS table_name,
               'st_' || CAST(p_partkey AS VARCHAR(19)) AS stxname, {d.numbers("CAST(2 + p_partkey % 3 AS INT)")} AS stxkeys,
               CASE p_partkey % 4 WHEN 0 THEN {d.array("'d'", "'f'")} WHEN 1 THEN {d.array("'f'")}
                    WHEN 2 THEN {d.array("'m'")} ELSE {d.array("'e'")} END AS stxkind
        FROM part"""

    out["relations"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, p_partkey AS oid,
               CASE p_partkey % 40 WHEN 37 THEN 'pg_catalog' WHEN 38 THEN 'pg_toast_9' WHEN 39 THEN 'information_schema'
                    WHEN 5 THEN 'public' ELSE lower(p_type) END AS schemaname,
               {table_name} AS table_name, {_words("p_partkey % 16", "v", "m", "f", "p", "i", "r")} AS relkind,
               'role_' || CAST({d.div("p_partkey", "9")} AS VARCHAR(19)) AS owner, p_partkey % 6 = 0 AS rowsecurity
        FROM part"""

    out["schemas"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, lower(p_type) AS schemaname, min(p_partkey) % 60 AS nspowner
        FROM part GROUP BY p_partkey % 4, lower(p_type)
        UNION ALL
        SELECT p_partkey % 4 AS server_id, {snap}, 'public' AS schemaname, min(p_partkey) % 60 AS nspowner FROM part GROUP BY p_partkey % 4"""

    out["hypertables"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, lower(p_type) AS schemaname, {table_name} AS table_name, p_partkey % 7 AS num_chunks
        FROM part"""

    out["table_constraints"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, 'fk_' || CAST(p_partkey AS VARCHAR(19)) AS constraint_name, lower(p_type) AS table_schema,
               {table_name} AS table_name, 'FOREIGN KEY' AS constraint_type FROM part
        UNION ALL
        SELECT p_partkey % 4 AS server_id, {snap}, 'pk_' || CAST(p_partkey AS VARCHAR(19)) AS constraint_name, lower(p_type) AS table_schema,
               {table_name} AS table_name, CASE WHEN p_size > 5 THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS constraint_type FROM part"""

    out["key_columns"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, 'fk_' || CAST(p_partkey AS VARCHAR(19)) AS constraint_name, lower(p_type) AS table_schema,
               'col_' || CAST(1 + p_partkey % 5 AS VARCHAR(9)) AS column_name, CAST(1 + p_partkey % 5 AS INT) AS column_position FROM part"""

    out["constraint_columns"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, 'fk_' || CAST(p_partkey AS VARCHAR(19)) AS constraint_name, lower(p_type) AS table_schema,
               'target_' || CAST({d.div("p_partkey", "2")} AS VARCHAR(19)) AS ref_table, 'id' AS ref_column FROM part"""

    out["referential_constraints"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, 'fk_' || CAST(p_partkey AS VARCHAR(19)) AS constraint_name, lower(p_type) AS table_schema,
               {_words("p_partkey % 3", "CASCADE", "NO ACTION", "SET NULL")} AS delete_rule,
               {_words("p_partkey % 2", "NO ACTION", "CASCADE")} AS update_rule FROM part"""

    local = d.div("c_custkey", "4")
    out["roles"] = f"""
        SELECT c_custkey % 4 AS server_id, {snap}, {local} AS oid,
               CASE WHEN {local} % 50 = 49 THEN 'pg_role_' ELSE 'role_' END || CAST({local} AS VARCHAR(19)) AS rolname,
               {local} % 500 = 0 AS rolsuper, c_custkey % 31 = 0 AS rolcreaterole, c_custkey % 17 = 0 AS rolcreatedb,
               c_custkey % 3 <> 0 AS rolcanlogin, c_custkey % 2 = 0 AS rolinherit, c_custkey % 29 = 0 AS rolreplication,
               c_custkey % 41 = 0 AS rolbypassrls, c_custkey % 60 - 1 AS rolconnlimit,
               CASE WHEN c_custkey % 23 <> 0 THEN 'set' END AS rolpassword,
               CASE WHEN c_custkey % 5 = 0 THEN {d.days_before("c_custkey % 90 - 45")} END AS rolvaliduntil
        FROM customer"""

    out["auth_members"] = f"""
        SELECT c_custkey % 4 AS server_id, {snap}, {d.div(local, "3")} AS roleid, {local} AS member FROM customer WHERE c_custkey >= 4
        UNION ALL
        SELECT c_custkey % 4 AS server_id, {snap}, CAST(13 AS BIGINT) AS roleid, CAST(1 AS BIGINT) AS member
        FROM customer WHERE {local} = 1"""

    obj = d.div("o_orderkey", "8")
    rolename = f"'role_' || CAST({d.div('o_custkey', '4')} AS VARCHAR(19))"
    out["grants"] = f"""
        SELECT (CASE WHEN o_orderkey % 10 = 0 THEN {obj} % 25 ELSE {obj} END) % 4 AS server_id, {snap},
               CASE WHEN o_orderkey % 1500 = 7 THEN 'PUBLIC' ELSE {rolename} END AS grantee,
               CASE WHEN o_orderkey % 10 = 0 THEN 'database' WHEN o_orderkey % 10 <= 2 THEN 'schema' ELSE 'table' END AS object_kind,
               CASE WHEN o_orderkey % 10 = 0 THEN 'NATION_' || CAST({obj} % 25 AS VARCHAR(9))
                    WHEN o_orderkey % 10 <= 2 THEN {_words("o_orderkey % 7", "medium", "standard", "economy", "small", "promo", "large", "public")}
                    ELSE CAST({obj} AS VARCHAR(19)) END AS object,
               CASE WHEN o_orderkey % 10 = 0 THEN {_words("o_orderkey % 3", "CONNECT", "CREATE", "TEMP")}
                    WHEN o_orderkey % 10 <= 2 THEN {_words("o_orderkey % 2", "USAGE", "CREATE")}
                    ELSE {_words("CAST(substring(o_orderpriority, 1, 1) AS INT) - 1", "SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE")} END AS privilege
        FROM orders"""

    out["functions"] = f"""
        SELECT s_suppkey % 4 AS server_id, {snap}, {_words("s_suppkey % 9", "pg_catalog", "information_schema", "public", "app")} AS schemaname,
               {_words("s_suppkey % 6", "login_", "get_", "admin_", "list_", "Drop_", "sum_")} || CAST(s_suppkey AS VARCHAR(19)) AS proname,
               'role_' || CAST(s_suppkey % 20 AS VARCHAR(9)) AS owner, s_suppkey % 4 = 0 AS prosecdef,
               s_suppkey % 3 = 0 AS public_execute, 'a int' AS arguments, 'int' AS result_type
        FROM supplier"""

    out["policies"] = f"""
        SELECT p_partkey % 4 AS server_id, {snap}, p_partkey AS polrelid, 'pol_' || CAST(k AS VARCHAR(9)) AS polname
        FROM {d.each("part", d.array("1", "2"), "k")} WHERE (p_partkey + k) % 12 = 1"""

    exts = d.array(*[d.record(j=str(j), name=_lit(n), version=_lit(v), about=_lit(a)) for j, (n, v, a) in enumerate(EXTENSIONS)])
    out["extensions"] = f"""
        SELECT c_custkey AS server_id, {snap}, k.name AS extname, k.version AS extversion,
               CASE WHEN k.j % 2 = 0 THEN 'public' ELSE 'pg_catalog' END AS schemaname,
               CASE WHEN k.j <> 4 THEN k.about END AS description,
               'role_' || CAST({local} % 12 AS VARCHAR(9)) AS owner
        FROM {d.each("customer", exts, "k")} WHERE (c_custkey + k.j) % 3 <> 0"""

    out["available_extensions"] = f"""
        SELECT c_custkey AS server_id, {snap}, k.name AS name, k.version AS default_version,
               CASE WHEN (c_custkey + k.j) % 3 <> 0 THEN k.version END AS installed_version, k.about AS comment
        FROM {d.each("customer", exts, "k")}"""

    out["tablespaces"] = f"""
        SELECT s_suppkey % 4 AS server_id, {snap}, 'space_' || CAST(s_suppkey AS VARCHAR(19)) AS spcname,
               (s_suppkey % 90) * (s_suppkey % 90) * 1000000 AS size_bytes, '/mnt/' || CAST(s_suppkey AS VARCHAR(19)) AS location
        FROM supplier"""

    out["buffercache"] = f"""
        SELECT c_custkey AS server_id, {snap}, {_words("k", "unused", "buffer content", "dirty")} AS category,
               'b' || CAST(k AS VARCHAR(9)) AS name, (c_custkey * (k + 3)) % 8192 AS buffers
        FROM {d.each("customer", d.array("0", "1", "2"), "k")}"""

    out["progress_vacuum"] = f"""
        SELECT event_id % 4 AS server_id, {snap}, event_id AS pid, {d.div("event_id", "5")} AS relid,
               {_words("event_id % 3", "scanning heap", "vacuuming indexes", "cleaning up")} AS phase
        FROM events"""

    bound = _words("c_nationkey % 4", "FOR VALUES FROM (1) TO (2)", "FOR VALUES IN (1)", "FOR VALUES WITH (modulus 4, remainder 0)", "DEFAULT")
    out["partition_nodes"] = f"""
        SELECT CAST(r_regionkey % 4 AS BIGINT) AS server_id, {snap}, CAST(r_regionkey AS BIGINT) AS oid, CAST(NULL AS BIGINT) AS parent_oid,
               'public' AS schemaname, lower(r_name) AS table_name, 'p' AS relkind, CAST(NULL AS VARCHAR(60)) AS partition_bound,
               CAST(0 AS BIGINT) AS total_size, CAST(0 AS BIGINT) AS table_size, CAST(NULL AS BIGINT) AS n_live_tup,
               CAST(NULL AS BIGINT) AS seq_scan, CAST(NULL AS BIGINT) AS seq_tup_read, CAST(NULL AS BIGINT) AS idx_scan, CAST(NULL AS BIGINT) AS idx_tup_fetch,
               CAST(NULL AS TIMESTAMP) AS last_vacuum, CAST(NULL AS TIMESTAMP) AS last_analyze
        FROM region
        UNION ALL
        SELECT CAST(n_regionkey % 4 AS BIGINT), {snap}, CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 'public', lower(n_name), 'p',
               {bound.replace("c_nationkey", "n_nationkey")}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM nation
        UNION ALL
        SELECT CAST(n_regionkey % 4 AS BIGINT), {snap}, c_custkey + 1000, CAST(100 + c_nationkey AS BIGINT), 'part', 'leaf_' || CAST(c_custkey AS VARCHAR(19)), 'r',
               {bound}, bytes + {d.div("bytes", "5")}, bytes, CASE WHEN c_custkey % 50 <> 49 THEN rows_n END,
               CASE WHEN c_custkey % 50 <> 49 THEN c_custkey % 300 END, CASE WHEN c_custkey % 50 <> 49 THEN c_custkey * 9 END,
               CASE WHEN c_custkey % 50 <> 49 THEN c_custkey % 200 END, CASE WHEN c_custkey % 50 <> 49 THEN c_custkey * 4 END,
               CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 50 <> 49 THEN {d.days_before("c_custkey % 15")} END,
               CASE WHEN c_custkey % 50 <> 49 THEN {d.days_before("c_custkey % 12")} END
        FROM (SELECT c_custkey, c_nationkey, n_regionkey, COALESCE(n, 0) * 1700 AS rows_n,
                     CAST(abs(round(c_acctbal * 100)) AS BIGINT) * (1 + c_custkey % 7) AS bytes
              FROM customer JOIN nation ON c_nationkey = n_nationkey
              LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey) leaves"""

    out["counters"] = f"""
        SELECT user_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts, event_type AS metric_key,
               {d.div("event_id", "2")} % 2000 AS value, event_id AS sample_id,
               {_words("event_id % 7", "async", "sync")} AS sync_state
        FROM events"""

    out["samples"] = f"""
        SELECT user_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts,
               {_words("event_id % 5", "xid_percent", "replication_lag_s", "cache_hit_percent", "blocked_s", "bloat_percent")} AS metric,
               event_type AS object, CAST((event_id * 37) % 1000 AS DOUBLE) AS value
        FROM events"""

    out["repl_history"] = f"""
        SELECT user_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts, 'standby_' || CAST(user_id % 3 AS VARCHAR(9)) AS application_name,
               CASE WHEN hour(ts) BETWEEN 6 AND 11 OR day(ts) % 5 = 0 THEN 'catchup' ELSE 'streaming' END AS state,
               {_words("event_id % 7", "async", "sync")} AS sync_state,
               CASE WHEN hour(ts) >= 18 THEN 31 + event_id % 50 ELSE event_id % 40 END AS replay_lag_s, event_id AS sample_id
        FROM events"""

    out["activity_history"] = f"""
        SELECT event_id % 4 AS server_id, date_trunc('minute', CAST(ts AS TIMESTAMP)) AS snap_ts, event_id AS pid,
               CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_type = 'view' THEN 'idle' WHEN event_type = 'signup' THEN 'idle in transaction'
                    WHEN event_type = 'error' THEN 'idle in transaction (aborted)' ELSE 'active' END AS state,
               CASE WHEN event_id % 9 = 0 THEN 'autovacuum: VACUUM t' ELSE 'SELECT 1' END AS query
        FROM events"""

    out["io_history"] = f"""
        SELECT event_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts, 'db' || CAST(user_id % 6 AS VARCHAR(9)) AS datname,
               (event_id * 13) % 100000 AS blks_hit, (event_id * 3) % 40000 AS blks_read, event_id AS sample_id
        FROM events"""

    out["transaction_history"] = f"""
        SELECT event_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts, 'db' || CAST(user_id % 6 AS VARCHAR(9)) AS datname,
               (event_id * 17) % 250000 AS xact_commit, {d.div("event_id", "3")} % 1500 AS xact_rollback, event_id AS sample_id
        FROM events"""

    out["checkpoint_history"] = f"""
        SELECT event_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts, {d.div("event_id", "3")} % 5000 AS checkpoints_timed,
               {d.div("event_id", "7")} % 900 AS checkpoints_req, (event_id * 11) % 60000 AS buffers_checkpoint, event_id AS sample_id
        FROM events"""

    out["pair_history"] = f"""
        SELECT event_id % 4 AS server_id, CAST(ts AS TIMESTAMP) AS snap_ts, user_id AS blocked_pid, user_id % 10 + 1000 AS blocking_pid
        FROM events"""

    out["statement_history"] = f"""
        SELECT l_partkey % 4 AS server_id, CAST(l_shipdate AS TIMESTAMP) AS snap_ts, l_partkey AS queryid,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS total_exec_time
        FROM lineitem GROUP BY l_partkey, l_shipdate"""

    out["size_history"] = f"""
        SELECT o_custkey % 4 AS server_id, CAST(o_orderdate AS TIMESTAMP) AS snap_ts, 'db' || CAST(o_custkey % 60 AS VARCHAR(9)) AS datname,
               o_orderkey * 1000 + o_custkey % 60 * 5000 AS size_bytes
        FROM orders"""

    out["stored_snapshots"] = f"""
        SELECT o_custkey % 4 AS server_id, CAST(o_orderdate AS TIMESTAMP) AS snap_ts, o_orderkey AS file_id,
               CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes
        FROM orders"""
    return out


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
