from fleetstat.plans import servers as S
from oracles.sqltext import NOW, age_s, clock, lsn, pretty, top

CUR = lsn("current_lsn")
WAL_FILE = f"printf('%08X%08X%08X', 1, (({CUR} - 1) // 16777216) // 256, (({CUR} - 1) // 16777216) % 256)"
SLOTS = f"""(SELECT r.*, current_lsn, {CUR} - {lsn('restart_lsn')} AS lag_bytes, {CUR} - {lsn('confirmed_flush_lsn')} AS flush_bytes
    FROM repl_slots r JOIN servers v ON v.server_id = r.server_id) x"""
PIVOT = """(SELECT server_id, snap_ts, max(setting) FILTER (name = 'archive_mode') AS archive_mode,
    max(setting) FILTER (name = 'archive_command') AS archive_command, max(setting) FILTER (name = 'wal_level') AS wal_level
    FROM settings GROUP BY server_id, snap_ts) p"""

SQL = {
    "rp1_slot_lag": f"""SELECT server_id, slot_name, slot_type, plugin, database, active, restart_lsn, confirmed_flush_lsn,
        lag_bytes AS replication_lag, {pretty('lag_bytes')} AS replication_lag_bytes, flush_bytes AS flush_lag,
        {pretty('flush_bytes')} AS flush_lag_bytes FROM {SLOTS}""",
    "rp2_standby_lag": f"""SELECT r.server_id, pid, application_name, client_addr, state, sync_state, {CUR} - {lsn('sent_lsn')} AS sending_lag,
        {CUR} - {lsn('write_lsn')} AS write_lag_bytes, {CUR} - {lsn('flush_lsn')} AS flush_lag_bytes, {CUR} - {lsn('replay_lsn')} AS replay_lag_bytes,
        write_lag_s AS write_lag_time, flush_lag_s AS flush_lag_time, replay_lag_s AS replay_lag_time
        FROM repl_stats r JOIN servers v ON v.server_id = r.server_id""",
    "rp3_replay_delay": f"SELECT server_id, {age_s('last_replay_ts')} AS replication_lag_seconds FROM servers WHERE in_recovery",
    "wl1_wal_position": f"SELECT server_id, {WAL_FILE} AS current_wal_file, current_lsn AS current_wal_lsn, {CUR} AS wal_bytes_written FROM servers",
    "wl2_archiver_status": f"""SELECT server_id, last_archived_wal AS last_archived_file, {clock('last_archived_time')} AS last_archived_time,
        last_failed_wal AS last_failed_file, {clock('last_failed_time')} AS last_failed_time, {clock('stats_reset')} AS stats_reset FROM archiver""",
    "wl3_wal_since_checkpoint": f"""SELECT server_id, checkpoint_lsn, redo_lsn, {lsn('checkpoint_lsn')} - {lsn('redo_lsn')} AS wal_bytes,
        {pretty(f"{lsn('checkpoint_lsn')} - {lsn('redo_lsn')}")} AS wal_generated FROM servers""",
    "bk1_backup_complexity": f"""SELECT server_id, datname AS database_name, size_bytes, {pretty('size_bytes')} AS current_size,
        {S.BACKUP_COMPLEXITY.sql()} AS backup_complexity, xid_age, {S.WRAPAROUND_RISK.sql()} AS wraparound_risk FROM database_stats""",
    "bk2_archive_config": f"""SELECT server_id, {S.ARCHIVE_MODE.sql()} AS archive_mode_status, archive_command,
        {S.ARCHIVE_COMMAND.sql()} AS archive_command_status, wal_level, {S.WAL_LEVEL.sql()} AS wal_level_status FROM {PIVOT}""",
    "bk3_archiver_health": f"""SELECT server_id, archived_count AS total_archived, last_archived_wal AS last_archived_file,
        {clock('la')} AS last_archived_time, archiving_health, failed_count AS total_failed, last_failed_wal AS last_failed_file,
        {clock('lf')} AS last_failed_time, failure_status FROM (SELECT * EXCLUDE (last_archived_time, last_failed_time), last_archived_time AS la,
        last_failed_time AS lf, {S.ARCHIVING.sql()} AS archiving_health, {S.ARCHIVE_FAILURES.sql()} AS failure_status FROM archiver) x""",
    "bk4_wal_position_context": f"""SELECT server_id, current_lsn AS current_wal_lsn, {WAL_FILE} AS current_wal_file, {pretty(CUR)} AS total_wal_generated,
        {S.WAL_CONTEXT.sql()} AS wal_position_context FROM (SELECT *, {age_s('started_at')} AS uptime_seconds FROM servers) x""",
    "bk5_slot_health": f"""SELECT server_id, slot_name, slot_type, database, active, restart_lsn, lag_bytes, {pretty('lag_bytes')} AS wal_lag_size,
        {S.SLOT_HEALTH.sql()} AS slot_health FROM {SLOTS}""",
    "bk6_backup_settings": f"""SELECT server_id, name AS parameter, setting AS current_value, unit, {S.BACKUP_RELEVANCE.sql()} AS backup_relevance
        FROM (SELECT *, TRY_CAST(setting AS DOUBLE) AS num FROM settings) x WHERE name IN ({', '.join(f"'{n}'" for n in S.BACKUP_SETTINGS)})""",
    "bk7_backup_challenging_tables": f"""SELECT server_id, schemaname || '.' || table_name AS table_name, total_relation_size AS total_bytes,
        {pretty('total_relation_size')} AS total_size, {pretty('relation_size')} AS table_size,
        {pretty('total_relation_size - relation_size')} AS indexes_toast_size, n_dead_tup AS dead_tuples, backup_considerations,
        {clock('lv')} AS last_vacuum, {clock('last_analyze')} AS last_analyze FROM ({top(f'''SELECT * EXCLUDE (last_vacuum), last_vacuum AS lv,
        {S.BACKUP_CONSIDERATIONS.sql()} AS backup_considerations FROM table_stats WHERE total_relation_size > 104857600''', 20, 'total_relation_size DESC, relid')}) x""",
    "bk8_backup_readiness": f"""SELECT p.server_id, {S.READINESS.sql().replace('snap_ts', NOW)} AS overall_status, {S.READINESS_ADVICE.sql()} AS primary_recommendation
        FROM {PIVOT} LEFT JOIN archiver a ON a.server_id = p.server_id
        LEFT JOIN (SELECT server_id, count(*) FILTER (NOT active AND lag_bytes > 1073741824) AS lagging_slots FROM {SLOTS} GROUP BY server_id) l ON l.server_id = p.server_id
        LEFT JOIN (SELECT server_id, max(xid_age) AS max_xid_age FROM database_stats GROUP BY server_id) d ON d.server_id = p.server_id""",
    "bk9_backup_commands": f"""SELECT server_id, datname AS database_name, size_bytes,
        CASE WHEN size_bytes > 10737418240 THEN '{S.DUMP}-Fd -j 4 -f backup_' || datname || '_2024-01-31 ' || datname
             WHEN size_bytes > 1073741824 THEN '{S.DUMP}-Fc -f backup_' || datname || '_2024-01-31.dump ' || datname
             ELSE '{S.DUMP}-f backup_' || datname || '_2024-01-31.sql ' || datname END AS suggested_backup_command,
        {S.FORMAT_RATIONALE.sql()} AS format_rationale FROM database_stats""",
}
