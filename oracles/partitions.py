from fleetstat.plans import partitions as P
from oracles.sqltext import clock, older, pretty

SIZES = """(SELECT c.server_id, p.schemaname || '.' || p.table_name AS parent_table, c.schemaname || '.' || c.table_name AS partition_name,
    c.total_size AS partition_size, c.table_size, coalesce(c.n_live_tup, 0) AS row_count, c.partition_bound, c.seq_scan, c.seq_tup_read,
    c.idx_scan, c.idx_tup_fetch, c.last_vacuum, c.last_analyze, c.snap_ts
    FROM partition_nodes c JOIN partition_nodes p ON p.server_id = c.server_id AND p.oid = c.parent_oid AND p.relkind = 'p') ps"""

SQL = {
    "pm1_partition_hierarchy": f"""WITH RECURSIVE walked AS (
          SELECT server_id, oid, 0 AS level, [schemaname || '.' || table_name] AS path FROM partition_nodes WHERE parent_oid IS NULL
          UNION ALL
          SELECT n.server_id, n.oid, w.level + 1, list_append(w.path, n.schemaname || '.' || n.table_name)
          FROM walked w JOIN partition_nodes n ON n.server_id = w.server_id AND n.parent_oid = w.oid),
        everywhere AS (SELECT * FROM walked UNION ALL SELECT n.server_id, n.oid, NULL, [schemaname || '.' || table_name] FROM partition_nodes n
          WHERE parent_oid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM walked w WHERE w.server_id = n.server_id AND w.oid = n.oid))
        SELECT w.server_id, repeat('  ', coalesce(level, 0)) || schemaname || '.' || table_name AS partition_hierarchy, level,
               CASE WHEN level IS NULL THEN 'UNREACHABLE' WHEN level = 0 THEN 'ROOT' WHEN relkind = 'p' THEN 'INTERMEDIATE' ELSE 'LEAF' END AS partition_type,
               {pretty('total_size')} AS total_size, {pretty('table_size')} AS table_size, coalesce(n_live_tup, 0) AS estimated_rows,
               len(path)::INT AS depth_in_hierarchy, array_to_string(path, ',') AS path
        FROM everywhere w JOIN partition_nodes n ON n.server_id = w.server_id AND n.oid = w.oid""",
    "pm2_partition_balance": f"""SELECT server_id, parent_table, partition_count, total_bytes, smallest_bytes, largest_bytes,
        {pretty('total_bytes')} AS total_partitioned_size, {pretty('round(avg_size)')} AS avg_partition_size,
        {pretty('smallest_bytes')} AS smallest_partition, {pretty('largest_bytes')} AS largest_partition,
        {P.SIZE_BALANCE.sql()} AS size_balance_assessment, total_estimated_rows, avg_rows_per_partition,
        {P.COUNT_ASSESSMENT.sql()} AS partition_count_assessment
        FROM (SELECT server_id, parent_table, count(*) AS partition_count, sum(partition_size)::BIGINT AS total_bytes,
              avg(partition_size) AS avg_size, stddev_samp(partition_size) AS size_stddev, min(partition_size) AS smallest_bytes,
              max(partition_size) AS largest_bytes, sum(row_count)::BIGINT AS total_estimated_rows,
              round(avg(row_count)) AS avg_rows_per_partition FROM {SIZES} GROUP BY server_id, parent_table) x""",
    "pm3_partition_health": f"""SELECT server_id, parent_table, partition_name, partition_bound, total_size_bytes,
        {pretty('total_size_bytes')} AS total_size, {pretty('table_size')} AS table_size, estimated_rows, sequential_scans, seq_tuples_read,
        index_scans, index_tuples_fetched, {clock('lv')} AS last_vacuum, {clock('la')} AS last_analyze, partition_health, maintenance_status
        FROM (SELECT * EXCLUDE (last_vacuum, last_analyze), last_vacuum AS lv, last_analyze AS la, {P.HEALTH.sql()} AS partition_health,
              {P.PARTITION_MAINTENANCE.sql()} AS maintenance_status FROM (SELECT *, partition_size AS total_size_bytes, row_count AS estimated_rows,
              coalesce(seq_scan, 0) AS sequential_scans, coalesce(seq_tup_read, 0) AS seq_tuples_read,
              coalesce(idx_scan, 0) AS index_scans, coalesce(idx_tup_fetch, 0) AS index_tuples_fetched FROM {SIZES}) a) b""",
    "pm4_partition_strategy_summary": f"""SELECT x.server_id, total_partitions, partition_strategies_used,
        constraint_exclusion AS constraint_exclusion_setting, {P.EXCLUSION.sql()} AS configuration_assessment,
        {P.PRUNING.sql()} AS pruning_efficiency_note
        FROM (SELECT n.server_id, count(*) AS total_partitions, count(DISTINCT {P.STRATEGY.sql()}) AS partition_strategies_used,
              max(m.setting) AS constraint_exclusion FROM partition_nodes n
              LEFT JOIN settings m ON m.server_id = n.server_id AND m.name = 'constraint_exclusion'
              WHERE parent_oid IS NOT NULL GROUP BY n.server_id) x""",
    "pm5_partition_advice": f"""SELECT server_id, parent_table, partition_count, empty_partitions, small_partitions, partitions_needing_vacuum,
        partitions_needing_analyze, {pretty('largest')} AS largest_partition, {pretty('smallest')} AS smallest_partition,
        {P.RECOMMENDATION.sql()} AS primary_recommendation,
        CASE WHEN partition_count > 12 THEN '-- Automated monthly cleanup: drop empty partitions named like ' || replace(parent_table, '.', '_') || '_%'
             ELSE '{P.CLEANUP_FEW}' END AS automation_suggestion
        FROM (SELECT server_id, parent_table, count(*) AS partition_count, count(*) FILTER (row_count = 0) AS empty_partitions,
              count(*) FILTER (partition_size < 1048576) AS small_partitions, count(*) FILTER ({older('last_vacuum', 604800)}) AS partitions_needing_vacuum,
              count(*) FILTER ({older('last_analyze', 604800)}) AS partitions_needing_analyze, max(partition_size) AS largest,
              min(partition_size) AS smallest FROM {SIZES} GROUP BY server_id, parent_table) x""",
    "pm6_partition_totals": f"""SELECT *, {pretty('partitioned_bytes')} AS total_partitioned_data, {P.IMPACT.sql()} AS performance_impact
        FROM (SELECT server_id, count(DISTINCT parent_oid) AS partitioned_tables, count(parent_oid) AS total_partitions,
              sum(total_size) FILTER (parent_oid IS NOT NULL)::BIGINT AS partitioned_bytes FROM partition_nodes GROUP BY server_id) x""",
}
