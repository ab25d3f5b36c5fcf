from fleetstat.plans import resources as R
from oracles.sqltext import clock, pct, pretty, top, unit_bytes

DEAD = pct("n_dead_tup", "(n_live_tup + n_dead_tup)")
FULL = "schemaname || '.' || table_name AS table_name"


def setting(name: str) -> str:
    return f"(SELECT max(setting) FROM settings WHERE name = '{name}' AND settings.server_id = x.server_id)"


def kpis() -> str:
    cond = {"total": "", "active": " FILTER (state = 'active')", "idle": " FILTER (state = 'idle')",
            "idle_tx": " FILTER (state = 'idle in transaction')"}
    branches = [f"SELECT server_id, '{title}' AS metric, count(*){cond[c]} AS current_value FROM activity GROUP BY server_id"
                for title, c in R.CONNECTION_KPIS.items()]
    return f"""SELECT x.*, m.setting::BIGINT AS max_configured, {pct('current_value', 'm.setting::BIGINT')} AS percent_used
        FROM ({' UNION ALL '.join(branches)}) x JOIN settings m ON m.server_id = x.server_id AND m.name = 'max_connections'"""


SUMMARY = """(SELECT a.server_id, current_connections, m.setting::BIGINT AS max_connections, hits, disk_reads, checkpoints_req, checkpoints_timed
    FROM (SELECT server_id, count(*) AS current_connections FROM activity GROUP BY server_id) a
    LEFT JOIN settings m ON m.server_id = a.server_id AND m.name = 'max_connections'
    LEFT JOIN (SELECT server_id, sum(blks_hit) AS hits, sum(blks_read) AS disk_reads FROM database_stats GROUP BY server_id) d
      ON d.server_id = a.server_id LEFT JOIN bgwriter b ON b.server_id = a.server_id) x"""

SQL = {
    "rm1_database_sizes": f"""SELECT server_id, datname AS database_name, {pretty('size_bytes')} AS size, size_bytes,
        {R.DATABASE_SIZE.sql()} AS size_category FROM database_stats WHERE NOT datistemplate""",
    "rm2_memory_settings": f"""SELECT server_id, name AS parameter, setting AS configured_value, unit, {unit_bytes()} AS bytes_value,
        {pretty(unit_bytes())} AS size_pretty, {R.MEMORY_SETTING.sql()} AS description FROM settings
        WHERE name IN ('shared_buffers', 'work_mem', 'maintenance_work_mem', 'effective_cache_size', 'wal_buffers', 'max_connections')""",
    "rm3_buffer_cache_usage": f"""SELECT b.server_id, CASE WHEN b.category = 'buffer content' THEN b.category || ' (' || b.name || ')' ELSE b.category END AS resource_type,
        buffers, {pretty('buffers * 8192')} AS size, {pct('buffers', 'setting::BIGINT')} AS percent_of_shared_buffers
        FROM buffercache b JOIN settings m ON m.server_id = b.server_id AND m.name = 'shared_buffers'""",
    "rm4_connection_kpis": kpis(),
    "rm5_database_io": f"""SELECT server_id, datname AS database_name, blks_read AS blocks_read_from_disk, blks_hit AS blocks_read_from_cache,
        {pct('blks_hit', '(blks_hit + blks_read)')} AS cache_hit_ratio, tup_returned AS tuples_returned, tup_fetched AS tuples_fetched,
        tup_inserted AS tuples_inserted, tup_updated AS tuples_updated, tup_deleted AS tuples_deleted,
        {R.CACHE_PERFORMANCE.sql()} AS cache_performance FROM database_stats""",
    "rm6_table_io_top": f"""SELECT server_id, schemaname, table_name, {pretty('total_relation_size')} AS total_size, total_relation_size AS size_bytes,
        heap_blks_read, heap_blks_hit, {pct('heap_blks_hit', '(heap_blks_hit + heap_blks_read)')} AS cache_hit_ratio,
        idx_blks_read, idx_blks_hit, {pct('idx_blks_hit', '(idx_blks_hit + idx_blks_read)')} AS index_hit_ratio,
        seq_scan, seq_tup_read, idx_scan, idx_tup_fetch
        FROM ({top('SELECT * FROM table_stats WHERE heap_blks_read + heap_blks_hit > 0', 20,
                   'heap_blks_read + heap_blks_hit + idx_blks_read + idx_blks_hit DESC, relid')}) x""",
    "rm7_index_utilization": f"""SELECT server_id, schemaname, table_name, index_name, {pretty('index_size')} AS index_size,
        idx_scan AS times_used, idx_tup_read AS tuples_read, idx_tup_fetch AS tuples_fetched,
        {R.INDEX_USAGE.sql()} AS usage_category, {R.INDEX_RECOMMENDATION.sql()} AS recommendation
        FROM ({top('SELECT * FROM index_stats', 25, 'index_size DESC, index_name')}) x""",
    "rm8_wal_kv": f"""SELECT server_id, 'WAL Location' AS metric, current_lsn AS current_value, 'Current WAL write location' AS description FROM servers
        UNION ALL SELECT server_id, 'WAL Buffers', {pretty('setting::BIGINT * 8192')}, 'Configured WAL buffer size' FROM settings WHERE name = 'wal_buffers'
        UNION ALL SELECT server_id, 'Checkpoint Segments', NULL, 'WAL segments between checkpoints (if applicable)' FROM servers
        UNION ALL SELECT server_id, 'Max WAL Size', setting, 'Maximum size to let WAL grow during automatic checkpoints' FROM settings WHERE name = 'max_wal_size'""",
    "rm9_bgwriter_unpivot": " UNION ALL ".join(
        f"SELECT server_id, '{t}' AS statistic, {c} AS value, '{d}' AS description FROM bgwriter" for c, (t, d) in R.BGWRITER.items()),
    "rm10_maintenance_status": f"""SELECT server_id, schemaname, table_name, n_tup_ins AS inserts, n_tup_upd AS updates, n_tup_del AS deletes,
        n_live_tup AS live_tuples, n_dead_tup AS dead_tuples, {DEAD} AS dead_tuple_ratio, {clock('last_vacuum')} AS last_vacuum,
        {clock('last_autovacuum')} AS last_autovacuum, {clock('last_analyze')} AS last_analyze,
        {clock('last_autoanalyze')} AS last_autoanalyze, {R.MAINTENANCE_STATUS.sql()} AS maintenance_status
        FROM ({top('SELECT * FROM table_stats WHERE n_live_tup + n_dead_tup > 0', 20, f'{DEAD} DESC NULLS LAST, relid')}) x""",
    "rm11_lock_modes": """SELECT server_id, mode AS lock_mode, count(*) AS lock_count, count(*) FILTER (NOT granted) AS waiting_locks,
        string_agg(DISTINCT locktype, ', ' ORDER BY locktype) AS lock_types FROM locks GROUP BY server_id, mode""",
    "rm12_resource_advice": " UNION ALL ".join(
        f"SELECT server_id, '{c}' AS category, {ladder.sql()} AS analysis FROM {SUMMARY}"
        for c, ladder in (("connections", R.CONNECTION_ADVICE), ("cache", R.CACHE_ADVICE), ("checkpoints", R.CHECKPOINT_ADVICE))),
    "bl1_table_bloat": f"""SELECT server_id, {FULL}, {pretty('total_relation_size')} AS total_size, n_dead_tup AS dead_tuples,
        n_live_tup AS live_tuples, {DEAD} AS dead_tuple_percent, {pretty('relation_size')} AS table_size,
        {clock('last_vacuum')} AS last_vacuum, {clock('last_autovacuum')} AS last_autovacuum
        FROM ({top('SELECT * FROM table_stats', 50, 'n_dead_tup DESC, relid')}) x""",
    "bl2_bloat_bands": f"""SELECT *, {R.BLOAT_BAND.sql()} AS band FROM (SELECT server_id, {FULL}, n_dead_tup AS dead_tuples,
        n_live_tup AS live_tuples, {DEAD} AS dead_tuple_percent FROM table_stats) x""",
    "bu1_cache_hit_overall": """SELECT server_id, sum(heap_blks_read)::BIGINT AS heap_read, sum(heap_blks_hit)::BIGINT AS heap_hit,
        sum(heap_blks_hit)::DOUBLE / nullif(sum(heap_blks_hit) + sum(heap_blks_read), 0)::DOUBLE AS ratio FROM table_stats GROUP BY server_id""",
    "bu2_cache_hit_by_table": f"""SELECT server_id, {FULL}, heap_blks_read, heap_blks_hit, hit_percent FROM ({top(
        f"SELECT *, {pct('heap_blks_hit', '(heap_blks_hit + heap_blks_read)')} AS hit_percent FROM table_stats WHERE heap_blks_hit + heap_blks_read > 0",
        20, 'hit_percent, heap_blks_read DESC, relid')}) x""",
    "tx1_database_xid_age": f"""SELECT server_id, datname AS database_name, xid_age AS age_in_transactions,
        {pct('xid_age', '2000000000')} AS percent_towards_wraparound, {pretty('size_bytes')} AS database_size, size_bytes FROM database_stats""",
    "tx2_table_xid_age": f"""SELECT server_id, {FULL}, xid_age AS age_in_transactions, {pct('xid_age', '2000000000')} AS percent_towards_wraparound,
        {pretty('total_relation_size')} AS total_size, {clock('last_vacuum')} AS last_vacuum, {clock('last_autovacuum')} AS last_autovacuum
        FROM ({top('SELECT * FROM table_stats', 20, 'xid_age DESC, relid')}) x""",
    "tx3_freeze_overdue": """SELECT t.server_id, t.schemaname || '.' || t.table_name AS table_name, xid_age AS age_in_transactions,
        xid_age - f.setting::BIGINT AS overdue_by FROM table_stats t
        JOIN settings m ON m.server_id = t.server_id AND m.name = 'autovacuum_freeze_max_age'
        JOIN settings f ON f.server_id = t.server_id AND f.name = 'vacuum_freeze_table_age'
        WHERE xid_age > least(m.setting::BIGINT + 50000000, 2147483648 - 40000000)""",
}
