from fleetstat.plans import security as P
from oracles.sqltext import NOW, clock, pretty

CLOSURE = """closure AS (SELECT server_id, member, roleid FROM auth_members
    UNION SELECT c.server_id, c.member, a.roleid FROM closure c JOIN auth_members a ON a.server_id = c.server_id AND a.member = c.roleid)"""
NAMED = "rolname NOT LIKE 'pg_%'"
OPEN = "rolcanlogin AND rolpassword IS NULL"
TABLES = """(SELECT r.*, t.n_live_tup, t.total_relation_size FROM relations r LEFT JOIN table_stats t ON t.server_id = r.server_id AND t.relid = r.oid
    WHERE relkind IN ('r', 'p') AND r.schemaname NOT IN ('pg_catalog', 'information_schema'))"""


#: Memberships whose rights reach the member: every role on the way but the last inherits.
REACH = """reach AS (SELECT a.server_id, a.member, a.roleid FROM auth_members a JOIN roles m ON m.server_id = a.server_id AND m.oid = a.member AND m.rolinherit
    UNION SELECT r.server_id, r.member, a.roleid FROM reach r JOIN auth_members a ON a.server_id = r.server_id AND a.member = r.roleid
      JOIN roles m ON m.server_id = a.server_id AND m.oid = a.member AND m.rolinherit)"""


def holders(kind: str, owners: str, flags: dict[str, str]) -> str:
    """One set of rights per role and object: own, inherited and everybody's grants, then ownership."""
    f = ", ".join(f"coalesce(bool_or(privilege = '{p}'), false) AS {c}" for c, p in flags.items())
    names = ", ".join(flags)
    return f"""WITH RECURSIVE {REACH},
        direct AS (SELECT DISTINCT server_id, grantee, object, privilege FROM grants WHERE object_kind = '{kind}'),
        gained AS (SELECT server_id, grantee AS role_name, object, privilege, false AS own FROM direct
            UNION ALL SELECT d.server_id, m.rolname, d.object, d.privilege, false FROM direct d
              JOIN roles g ON g.server_id = d.server_id AND g.rolname = d.grantee
              JOIN reach c ON c.server_id = g.server_id AND c.roleid = g.oid
              JOIN roles m ON m.server_id = c.server_id AND m.oid = c.member
            UNION ALL {owners}),
        added AS (SELECT * FROM gained UNION ALL SELECT DISTINCT g.server_id, g.role_name, d.object, d.privilege, false FROM direct d
            JOIN (SELECT DISTINCT server_id, role_name, object FROM gained) g ON g.server_id = d.server_id AND g.object = d.object WHERE d.grantee = 'PUBLIC'),
        held AS (SELECT server_id, role_name, object, bool_or(own) AS is_owner, {f} FROM added GROUP BY server_id, role_name, object),
        logins AS (SELECT server_id, rolname AS role_name, rolsuper AS is_super FROM roles WHERE {NAMED} AND rolcanlogin),
        holders AS (SELECT h.server_id, h.role_name, object, is_owner, {', '.join(f"is_super OR {c} AS {c}" for c in flags)}, is_super FROM held h
              JOIN logins l ON l.server_id = h.server_id AND l.role_name = h.role_name WHERE NOT is_super OR is_owner
            UNION ALL SELECT server_id, role_name, object, is_owner, {names}, false FROM held WHERE role_name = 'PUBLIC'
            UNION ALL SELECT server_id, role_name, '*', false, {', '.join('true' for _ in flags)}, true FROM logins WHERE is_super)"""


METRICS = """(SELECT r.server_id, superuser_count, passwordless_count, coalesce(public_schema_tables, 0) AS public_schema_tables,
    coalesce(risky_functions, 0) AS risky_functions, coalesce(tables_needing_rls, 0) AS tables_needing_rls
    FROM (SELECT server_id, count(*) FILTER (rolsuper) AS superuser_count, count(*) FILTER (rolcanlogin AND rolpassword IS NULL) AS passwordless_count
          FROM roles GROUP BY server_id) r
    LEFT JOIN (SELECT server_id, count(*) FILTER (schemaname = 'public') AS public_schema_tables,
               count(*) FILTER (NOT rowsecurity AND regexp_matches(table_name, '""" + P.RLS_SENSITIVE + """', 'i')) AS tables_needing_rls
               FROM relations WHERE relkind IN ('r', 'p') GROUP BY server_id) t ON t.server_id = r.server_id
    LEFT JOIN (SELECT server_id, count(*) FILTER (prosecdef AND public_execute) AS risky_functions FROM functions
               WHERE schemaname NOT IN ('pg_catalog', 'information_schema') GROUP BY server_id) f ON f.server_id = r.server_id) m"""

SQL = {
    "rc2_role_closure_pairs": f"WITH RECURSIVE {CLOSURE} SELECT server_id, member, roleid FROM closure",
    "pa1_role_risk": f"""SELECT r.server_id, rolname AS role_name, rolsuper AS is_superuser, rolinherit AS inherits_privileges,
        rolcreaterole AS can_create_roles, rolcreatedb AS can_create_databases, rolcanlogin AS can_login, rolreplication AS replication_privilege,
        rolbypassrls AS bypasses_rls, rolconnlimit AS connection_limit,
        CASE WHEN rolpassword IS NULL THEN 'NO PASSWORD SET' ELSE 'PASSWORD SET' END AS password_status,
        {clock('rolvaliduntil')} AS password_expiry, {P.ROLE_RISK.sql()} AS security_risk_level,
        (SELECT count(*) FROM auth_members a JOIN roles m ON m.server_id = a.server_id AND m.oid = a.member
         JOIN roles g ON g.server_id = a.server_id AND g.oid = a.roleid WHERE a.server_id = r.server_id AND a.roleid = r.oid) AS role_member_count,
        (SELECT count(*) FROM auth_members a JOIN roles m ON m.server_id = a.server_id AND m.oid = a.roleid
         JOIN roles g ON g.server_id = a.server_id AND g.oid = a.member WHERE a.server_id = r.server_id AND a.member = r.oid) AS member_of_count
        FROM roles r WHERE {NAMED}""",
    "pa1l_role_memberships": """SELECT a.server_id, g.rolname AS role_name, m.rolname AS member_name FROM auth_members a
        JOIN roles m ON m.server_id = a.server_id AND m.oid = a.member JOIN roles g ON g.server_id = a.server_id AND g.oid = a.roleid""",
    "pa2_privileged_summary": f"""SELECT *, {P.PRIVILEGED.sql()} AS security_assessment FROM (SELECT server_id,
        count(*) FILTER (rolsuper) AS superuser_count, count(*) FILTER (rolcreaterole) AS role_creators_count,
        count(*) FILTER (rolcreatedb) AS db_creators_count, count(*) FILTER ({OPEN}) AS passwordless_login_roles,
        count(*) FILTER (rolbypassrls) AS rls_bypass_roles FROM roles WHERE {NAMED} GROUP BY server_id) x""",
    "pa2l_privileged_roles": f"""SELECT server_id, rolname AS role_name, 'superuser' AS kind FROM roles WHERE {NAMED} AND rolsuper
        UNION ALL SELECT server_id, rolname, 'passwordless' FROM roles WHERE {NAMED} AND {OPEN}""",
    "pa3_database_access": holders("database", """SELECT d.server_id, r.rolname, d.datname, NULL, true FROM database_stats d
            JOIN roles r ON r.server_id = d.server_id AND r.oid = d.datdba""", {"can_connect": "CONNECT", "can_create": "CREATE", "can_temp": "TEMP"})
    + f""" SELECT h.server_id, object AS database_name, role_name, CASE WHEN is_owner THEN 'OWNER' WHEN can_connect THEN 'CONNECT' ELSE 'NO ACCESS' END AS database_privilege,
        CASE WHEN can_create THEN 'YES' ELSE 'NO' END AS can_create_schemas, CASE WHEN can_temp THEN 'YES' ELSE 'NO' END AS can_create_temp_tables,
        {pretty('size_bytes')} AS database_size, {P.DATABASE_ACCESS.sql()} AS access_description
        FROM holders h LEFT JOIN database_stats d ON d.server_id = h.server_id AND d.datname = h.object WHERE is_owner OR can_connect OR is_super""",
    "pa4_schema_access": holders("schema", """SELECT d.server_id, r.rolname, d.schemaname, NULL, true FROM schemas d
            JOIN roles r ON r.server_id = d.server_id AND r.oid = d.nspowner""", {"has_usage": "USAGE", "has_create": "CREATE"})
    + f""" SELECT *, {P.SCHEMA_ACCESS.sql()} AS privilege_summary FROM (SELECT h.server_id, object AS schema_name, role_name, is_owner, has_usage, has_create,
        coalesce((SELECT count(*) FROM relations r WHERE r.server_id = h.server_id AND r.schemaname = h.object AND relkind = 'r'), 0) AS table_count,
        coalesce((SELECT count(*) FROM functions f WHERE f.server_id = h.server_id AND f.schemaname = h.object), 0) AS function_count
        FROM holders h WHERE is_owner OR has_usage OR has_create OR is_super) x""",
    "pa5_table_access": holders("table", f"""SELECT t.server_id, t.owner, t.oid::VARCHAR, NULL, true FROM {TABLES} t""",
                                {f"can_{p.lower()}": p for p in P.TABLE_PRIVILEGES})
    + f""" SELECT server_id, table_name, table_owner, role_name, table_privileges, table_size, estimated_rows, {P.SENSITIVITY.sql()} AS data_sensitivity,
        risk_assessment FROM (SELECT h.server_id, coalesce(t.schemaname || '.' || t.table_name, object) AS table_name, t.owner AS table_owner, role_name,
        {' || '.join(f"CASE WHEN can_{p.lower()} THEN '{p} ' ELSE '' END" for p in P.TABLE_PRIVILEGES)} AS table_privileges,
        {pretty('total_relation_size')} AS table_size, n_live_tup AS estimated_rows,
        coalesce(regexp_matches(t.table_name, '{P.SENSITIVE}', 'i'), false) AS is_sensitive, {P.TABLE_RISK.sql()} AS risk_assessment
        FROM holders h LEFT JOIN {TABLES} t ON t.server_id = h.server_id AND t.oid::VARCHAR = h.object
        WHERE (is_owner OR can_select OR can_insert OR can_update OR can_delete OR is_super) AND (t.oid IS NOT NULL OR object = '*')) x""",
    "pa6_function_risk": f"""SELECT server_id, schemaname AS schema_name, proname AS function_name, owner AS function_owner,
        CASE WHEN prosecdef THEN 'SECURITY DEFINER' ELSE 'SECURITY INVOKER' END AS security_mode,
        CASE WHEN public_execute THEN 'PUBLIC EXECUTE' ELSE 'RESTRICTED ACCESS' END AS access_control, arguments AS function_arguments,
        result_type AS return_type, {P.FUNCTION_RISK.sql()} AS security_risk, {P.FUNCTION_ADVICE.sql()} AS security_recommendation
        FROM (SELECT *, regexp_matches(proname, '{P.ADMIN_NAMES}', 'i') AS admin_name FROM functions) x
        WHERE schemaname NOT IN ('pg_catalog', 'information_schema')""",
    "pa7_rls_audit": f"""SELECT server_id, schemaname || '.' || tn AS table_name, rowsecurity AS rls_enabled,
        CASE WHEN rowsecurity THEN 'ENABLED' ELSE 'DISABLED' END AS rls_status, policy_count, {P.RLS.sql()} AS rls_assessment,
        {pretty('total_relation_size')} AS table_size, n_live_tup AS estimated_rows
        FROM (SELECT t.* EXCLUDE (table_name), table_name AS tn, regexp_matches(table_name, '{P.RLS_SENSITIVE}', 'i') AS wants_rls,
              coalesce((SELECT count(*) FROM policies p WHERE p.server_id = t.server_id AND p.polrelid = t.oid), 0) AS policy_count FROM {TABLES} t) x""",
    "pa8_authentication_summary": f"""SELECT x.* EXCLUDE (ssl, password_encryption), password_encryption AS password_encryption_method, ssl AS ssl_enabled,
        {P.AUTH_STATUS.sql()} AS security_status, {P.AUTH_ADVICE.sql()} AS primary_recommendation FROM (
        SELECT r.*, e.setting AS password_encryption, s.setting AS ssl FROM (SELECT server_id, count(*) FILTER (rolcanlogin) AS total_login_roles,
          count(*) FILTER ({OPEN}) AS passwordless_roles, count(*) FILTER (rolcanlogin AND rolvaliduntil < {NOW}) AS expired_password_roles,
          count(*) FILTER (rolsuper) AS superuser_roles FROM roles GROUP BY server_id) r
        LEFT JOIN settings e ON e.server_id = r.server_id AND e.name = 'password_encryption'
        LEFT JOIN settings s ON s.server_id = r.server_id AND s.name = 'ssl') x""",
    "pa9_security_grade": f"""SELECT server_id, superuser_count || ' superuser accounts' AS superuser_status,
        passwordless_count || ' passwordless login roles' AS authentication_status, public_schema_tables || ' tables in public schema' AS schema_security_status,
        risky_functions || ' high-risk SECURITY DEFINER functions' AS function_security_status,
        tables_needing_rls || ' sensitive tables without RLS' AS rls_status, {P.GRADE.sql()} AS overall_security_grade FROM {METRICS}""",
}
