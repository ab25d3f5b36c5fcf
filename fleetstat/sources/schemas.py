"""Schemas of the telemetry relations, as DDL."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "activity": (
        "server_id bigint, snap_ts timestamp, pid bigint, datname string, usename string, "
        "application_name string, client_addr string, backend_type string, state string, "
        "wait_event_type string, wait_event string, query_start timestamp, xact_start timestamp, "
        "backend_start timestamp, state_change timestamp, query string, is_collector boolean"
    ),
    "statements": (
        "server_id bigint, snap_ts timestamp, queryid bigint, query string, calls bigint, rows bigint, "
        "total_exec_time double, mean_exec_time double, min_exec_time double, max_exec_time double, "
        "stddev_exec_time double, total_plan_time double, mean_plan_time double, shared_blks_hit bigint, "
        "shared_blks_read bigint, shared_blks_written bigint, shared_blks_dirtied bigint, "
        "local_blks_read bigint, local_blks_written bigint, temp_blks_read bigint, temp_blks_written bigint, "
        "wal_records bigint, wal_fpi bigint, wal_bytes bigint, jit_functions bigint, "
        "jit_generation_time double, jit_inlining_count bigint, jit_inlining_time double, "
        "jit_optimization_count bigint, jit_optimization_time double, jit_emission_count bigint, "
        "jit_emission_time double"
    ),
    "locks": (
        "server_id bigint, snap_ts timestamp, pid bigint, locktype string, database bigint, relation bigint, "
        "transactionid bigint, page bigint, tuple bigint, virtualxid string, classid bigint, objid bigint, "
        "objsubid bigint, mode string, granted boolean"
    ),
    "table_stats": (
        "server_id bigint, snap_ts timestamp, relid bigint, schemaname string, table_name string, "
        "n_live_tup bigint, n_dead_tup bigint, n_tup_ins bigint, n_tup_upd bigint, n_tup_del bigint, "
        "n_tup_hot_upd bigint, seq_scan bigint, seq_tup_read bigint, idx_scan bigint, idx_tup_fetch bigint, "
        "last_vacuum timestamp, last_autovacuum timestamp, last_analyze timestamp, "
        "last_autoanalyze timestamp, relation_size bigint, total_relation_size bigint, xid_age bigint, "
        "heap_blks_read bigint, heap_blks_hit bigint, idx_blks_read bigint, idx_blks_hit bigint, "
        "reloptions array<string>"
    ),
    "index_stats": (
        "server_id bigint, snap_ts timestamp, relid bigint, schemaname string, table_name string, "
        "index_name string, indkey array<int>, idx_scan bigint, idx_tup_read bigint, idx_tup_fetch bigint, "
        "index_size bigint, indexdef string"
    ),
    "database_stats": (
        "server_id bigint, snap_ts timestamp, datname string, datid bigint, numbackends bigint, "
        "xact_commit bigint, xact_rollback bigint, blks_hit bigint, blks_read bigint, tup_returned bigint, "
        "tup_fetched bigint, tup_inserted bigint, tup_updated bigint, tup_deleted bigint, deadlocks bigint, "
        "temp_files bigint, temp_bytes bigint, stats_reset timestamp, size_bytes bigint, xid_age bigint, "
        "datistemplate boolean, datdba bigint, datacl string"
    ),
    "settings": (
        "server_id bigint, snap_ts timestamp, name string, setting string, unit string, category string, "
        "short_desc string, context string, vartype string, source string, boot_val string, "
        "pending_restart boolean"
    ),
    "servers": (
        "server_id bigint, snap_ts timestamp, host string, port int, version string, started_at timestamp, "
        "in_recovery boolean, current_lsn string, checkpoint_lsn string, redo_lsn string, "
        "last_replay_ts timestamp, ram_bytes bigint, workload string, disk_bytes bigint"
    ),
    "archiver": (
        "server_id bigint, snap_ts timestamp, archived_count bigint, last_archived_wal string, "
        "last_archived_time timestamp, failed_count bigint, last_failed_wal string, "
        "last_failed_time timestamp, stats_reset timestamp"
    ),
    "bgwriter": (
        "server_id bigint, snap_ts timestamp, checkpoints_timed bigint, checkpoints_req bigint, "
        "checkpoint_write_time bigint, checkpoint_sync_time bigint, buffers_checkpoint bigint, "
        "buffers_clean bigint, buffers_backend bigint"
    ),
    "repl_slots": (
        "server_id bigint, snap_ts timestamp, slot_name string, slot_type string, plugin string, "
        "database string, active boolean, restart_lsn string, confirmed_flush_lsn string"
    ),
    "repl_stats": (
        "server_id bigint, snap_ts timestamp, pid bigint, application_name string, client_addr string, "
        "state string, sync_state string, sent_lsn string, write_lsn string, flush_lsn string, "
        "replay_lsn string, write_lag_s bigint, flush_lag_s bigint, replay_lag_s bigint"
    ),
    "column_stats": (
        "server_id bigint, snap_ts timestamp, relid bigint, schemaname string, table_name string, "
        "attname string, null_frac double, n_distinct double, avg_width bigint, "
        "most_common_vals array<string>, histogram_bounds array<string>, correlation double, "
        "attstattarget bigint"
    ),
    "ext_stats": (
        "server_id bigint, snap_ts timestamp, relid bigint, schemaname string, table_name string, "
        "stxname string, stxkeys array<int>, stxkind array<string>"
    ),
    "relations": (
        "server_id bigint, snap_ts timestamp, oid bigint, schemaname string, table_name string, "
        "relkind string, owner string, rowsecurity boolean"
    ),
    "schemas": (
        "server_id bigint, snap_ts timestamp, schemaname string, nspowner bigint"
    ),
    "hypertables": (
        "server_id bigint, snap_ts timestamp, schemaname string, table_name string, num_chunks bigint"
    ),
    "table_constraints": (
        "server_id bigint, snap_ts timestamp, constraint_name string, table_schema string, "
        "table_name string, constraint_type string"
    ),
    "key_columns": (
        "server_id bigint, snap_ts timestamp, constraint_name string, table_schema string, "
        "column_name string, column_position int"
    ),
    "constraint_columns": (
        "server_id bigint, snap_ts timestamp, constraint_name string, table_schema string, ref_table string, "
        "ref_column string"
    ),
    "referential_constraints": (
        "server_id bigint, snap_ts timestamp, constraint_name string, table_schema string, "
        "delete_rule string, update_rule string"
    ),
    "roles": (
        "server_id bigint, snap_ts timestamp, oid bigint, rolname string, rolsuper boolean, "
        "rolcreaterole boolean, rolcreatedb boolean, rolcanlogin boolean, rolinherit boolean, "
        "rolreplication boolean, rolbypassrls boolean, rolconnlimit bigint, rolpassword string, "
        "rolvaliduntil timestamp"
    ),
    "auth_members": (
        "server_id bigint, snap_ts timestamp, roleid bigint, member bigint"
    ),
    "grants": (
        "server_id bigint, snap_ts timestamp, grantee string, object_kind string, object string, "
        "privilege string"
    ),
    "functions": (
        "server_id bigint, snap_ts timestamp, schemaname string, proname string, owner string, "
        "prosecdef boolean, public_execute boolean, arguments string, result_type string"
    ),
    "policies": (
        "server_id bigint, snap_ts timestamp, polrelid bigint, polname string"
    ),
    "extensions": (
        "server_id bigint, snap_ts timestamp, extname string, extversion string, schemaname string, "
        "description string, owner string"
    ),
    "available_extensions": (
        "server_id bigint, snap_ts timestamp, name string, default_version string, installed_version string, "
        "comment string"
    ),
    "tablespaces": (
        "server_id bigint, snap_ts timestamp, spcname string, size_bytes bigint, location string"
    ),
    "buffercache": (
        "server_id bigint, snap_ts timestamp, category string, name string, buffers bigint"
    ),
    "progress_vacuum": (
        "server_id bigint, snap_ts timestamp, pid bigint, relid bigint, phase string"
    ),
    "partition_nodes": (
        "server_id bigint, snap_ts timestamp, oid bigint, parent_oid bigint, schemaname string, "
        "table_name string, relkind string, partition_bound string, total_size bigint, table_size bigint, "
        "n_live_tup bigint, seq_scan bigint, seq_tup_read bigint, idx_scan bigint, idx_tup_fetch bigint, "
        "last_vacuum timestamp, last_analyze timestamp"
    ),
    "counters": (
        "server_id bigint, snap_ts timestamp, metric_key string, value bigint, sample_id bigint, "
        "sync_state string"
    ),
    "samples": (
        "server_id bigint, snap_ts timestamp, metric string, object string, value double"
    ),
    "repl_history": (
        "server_id bigint, snap_ts timestamp, application_name string, state string, sync_state string, "
        "replay_lag_s bigint, sample_id bigint"
    ),
    "activity_history": (
        "server_id bigint, snap_ts timestamp, pid bigint, state string, query string"
    ),
    "io_history": (
        "server_id bigint, snap_ts timestamp, datname string, blks_hit bigint, blks_read bigint, "
        "sample_id bigint"
    ),
    "transaction_history": (
        "server_id bigint, snap_ts timestamp, datname string, xact_commit bigint, xact_rollback bigint, "
        "sample_id bigint"
    ),
    "checkpoint_history": (
        "server_id bigint, snap_ts timestamp, checkpoints_timed bigint, checkpoints_req bigint, "
        "buffers_checkpoint bigint, sample_id bigint"
    ),
    "pair_history": (
        "server_id bigint, snap_ts timestamp, blocked_pid bigint, blocking_pid bigint"
    ),
    "statement_history": (
        "server_id bigint, snap_ts timestamp, queryid bigint, calls bigint, total_exec_time double"
    ),
    "size_history": (
        "server_id bigint, snap_ts timestamp, datname string, size_bytes bigint"
    ),
    "stored_snapshots": (
        "server_id bigint, snap_ts timestamp, file_id bigint, size_bytes bigint"
    ),
}

# Columns a server version or a missing extension may leave out.
OPTIONAL: dict[str, tuple[str, ...]] = {
    "statements": (
        "jit_functions", "jit_generation_time", "jit_inlining_count", "jit_inlining_time",
        "jit_optimization_count", "jit_optimization_time", "jit_emission_count", "jit_emission_time",
        "wal_records", "wal_fpi", "wal_bytes", "total_plan_time", "mean_plan_time",
    ),
    "activity": ("application_name", "client_addr", "backend_type", "is_collector"),
    "table_stats": ("xid_age", "reloptions"),
    "repl_slots": ("plugin",),
    "extensions": ("description", "owner"),
}
