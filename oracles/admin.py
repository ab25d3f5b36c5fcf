from fleetstat.plans import admin as A
from oracles.indexes import FK
from oracles.sqltext import pretty

SYSTEM = "('pg_catalog', 'information_schema')"

SQL = {
    "ad1_foreign_keys": f"""SELECT fk.server_id, fk.constraint_name, fk.table_schema || '.' || table_name AS source_table, column_name AS source_column,
        fk.table_schema || '.' || ref_table AS referenced_table, ref_column AS referenced_column, delete_rule AS on_delete, update_rule AS on_update
        FROM {FK} JOIN referential_constraints r ON r.server_id = fk.server_id AND r.constraint_name = fk.constraint_name AND r.table_schema = fk.table_schema""",
    "ad2_non_hypertables": f"""SELECT server_id, schemaname, table_name, total_relation_size AS size_bytes, {pretty('total_relation_size')} AS size,
        n_live_tup AS estimated_rows FROM table_stats t WHERE NOT EXISTS (SELECT 1 FROM hypertables h
        WHERE h.server_id = t.server_id AND h.schemaname = t.schemaname AND h.table_name = t.table_name)""",
    "ad3_available_extensions": "SELECT server_id, name, default_version, installed_version, comment FROM available_extensions",
    "ad4_installed_extensions": "SELECT server_id, extname AS extension_name, extversion AS version, schemaname AS schema, description FROM extensions",
    "ad5_table_ownership": f"""SELECT server_id, schemaname AS schema_name, table_name, owner, {A.RELATION_KIND.sql()} AS table_type FROM relations
        WHERE relkind IN ('r', 'v', 'm', 'f', 'p') AND schemaname NOT IN {SYSTEM} AND schemaname NOT LIKE 'pg_toast%'""",
    "ad6_unexpected_owners": f"""SELECT server_id, schemaname, table_name, owner FROM relations WHERE relkind IN ('r', 'p')
        AND schemaname NOT IN {SYSTEM} AND owner NOT IN ('app_user', 'service_account')""",
    "ad7_public_grants": "SELECT server_id, grantee, object_kind, object, privilege FROM grants WHERE grantee = 'PUBLIC'",
    "ad8_risky_extensions": "SELECT server_id, extname, extversion FROM extensions WHERE extname IN ('dblink', 'postgres_fdw', 'file_fdw', 'adminpack')",
    "ad8r_extension_owner_roles": """SELECT server_id, rolname, rolsuper, rolcreaterole, rolcreatedb FROM roles r WHERE EXISTS (
        SELECT 1 FROM extensions e WHERE e.server_id = r.server_id AND e.owner = r.rolname AND extname <> 'plpgsql')""",
    "ad9_tables_without_primary_key": f"""SELECT server_id, schemaname, table_name FROM relations r WHERE relkind IN ('r', 'p') AND schemaname NOT IN {SYSTEM}
        AND NOT EXISTS (SELECT 1 FROM table_constraints c WHERE c.server_id = r.server_id AND c.constraint_type = 'PRIMARY KEY'
                        AND c.table_schema = r.schemaname AND c.table_name = r.table_name)""",
    "ad10_fk_prefix_index_missing": f"""SELECT fk.server_id, constraint_name, table_schema || '.' || table_name AS table_name, column_position::VARCHAR AS columns
        FROM {FK} WHERE NOT EXISTS (SELECT 1 FROM index_stats i WHERE i.server_id = fk.server_id AND i.schemaname = fk.table_schema
        AND i.table_name = fk.table_name AND i.indkey[1] = fk.column_position)""",
    "ad11_hypertable_sizes": f"""SELECT h.server_id, h.schemaname, h.table_name, num_chunks, total_relation_size AS size_bytes, {pretty('total_relation_size')} AS size
        FROM hypertables h JOIN table_stats t ON t.server_id = h.server_id AND t.schemaname = h.schemaname AND t.table_name = h.table_name""",
    "j14_orders_validate_orders_customer": """SELECT o_custkey, count(*) AS orphan_rows FROM orders WHERE o_custkey NOT IN
        (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
    "j14_lineitem_validate_lineitem_orders": """SELECT l_orderkey, count(*) AS orphan_rows FROM lineitem WHERE NOT EXISTS
        (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey""",
    "j14_labels_validate_labels_documents": """SELECT doc_id, count(*) AS orphan_rows FROM labels WHERE doc_id NOT IN
        (SELECT doc_id FROM documents) GROUP BY doc_id""",
    "j14_members_validate_members_roles": """SELECT server_id, roleid, count(*) AS orphan_rows FROM auth_members m WHERE NOT EXISTS
        (SELECT 1 FROM roles r WHERE r.server_id = m.server_id AND r.oid = m.roleid) GROUP BY server_id, roleid""",
}
