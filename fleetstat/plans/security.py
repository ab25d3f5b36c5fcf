"""Roles, effective privileges, functions and row security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, SYSTEM_SCHEMAS, Ladder, matches_ci, pretty_bytes, qualified, n_rows
from fleetstat.operators.graphs import role_closure
from fleetstat.operators.joins import pivot_settings, shuffled
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

ALL_OBJECTS = "*"

# Name patterns, thresholds and labels of the security reports.
SENSITIVE = "(user|customer|person|employee|patient|account|payment|credit|password|ssn|tax)"
RLS_SENSITIVE = "(user|customer|tenant|account|private)"
ADMIN_NAMES = "(admin|super|root|password|auth|login|create|drop|alter|delete|grant|revoke)"
ROLE_RISK = Ladder(
    ("rolsuper", "CRITICAL: Superuser - unlimited access"),
    ("rolcreaterole", "HIGH: Can create roles - potential privilege escalation"),
    ("rolcreatedb", "MEDIUM: Can create databases"),
    ("rolcanlogin AND rolpassword IS NULL", "HIGH: Login without password"),
    ("rolcanlogin", "NORMAL: Standard login role"),
    default="LOW: Non-login role",
)
PRIVILEGED = Ladder(
    ("superuser_count > 2", "WARNING: Multiple superuser accounts detected"),
    ("passwordless_login_roles > 0", "CRITICAL: Passwordless login roles exist"),
    ("role_creators_count > 3", "NOTICE: Many role creation privileges granted"),
    default="OK: Reasonable high-privilege role distribution",
)
DATABASE_ACCESS = Ladder(
    ("is_owner", "Database owner has full control"), ("is_super", "Superuser has unlimited access"),
    ("can_create", "Can modify database structure"), ("can_connect", "Standard database access"),
    default="No database access",
)
SCHEMA_ACCESS = Ladder(
    ("schema_name = 'public' AND has_create", "WARNING: Public schema CREATE privilege"), ("is_owner", "Schema owner"),
    ("has_create", "Can create objects"), ("has_usage", "Can access objects"),
    default="No schema access",
)
TABLE_RISK = Ladder(
    ("is_owner", "Table owner has full control"), ("is_super", "Superuser has unlimited access"),
    ("can_delete OR can_truncate", "HIGH RISK: Can delete data"), ("can_update", "MEDIUM RISK: Can modify data"),
    ("can_select", "LOW RISK: Read-only access"),
    default="NO ACCESS",
)
SENSITIVITY = Ladder(
    ("is_sensitive", "SENSITIVE: Potentially contains PII/sensitive data"), ("estimated_rows > 1000000", "LARGE: High-volume table"),
    default="STANDARD: Regular table",
)
FUNCTION_RISK = Ladder(
    ("prosecdef AND public_execute", "CRITICAL: SECURITY DEFINER with PUBLIC access"),
    ("prosecdef", "HIGH: SECURITY DEFINER function - review carefully"),
    ("admin_name", "MEDIUM: Function name suggests administrative purpose"),
    default="LOW: Standard function",
)
FUNCTION_ADVICE = Ladder(
    ("prosecdef AND public_execute", "Review function code and restrict access with REVOKE/GRANT"),
    ("prosecdef", "Ensure function performs appropriate security checks"),
    default="Standard function security practices apply",
)
RLS = Ladder(
    ("rowsecurity AND policy_count = 0", "WARNING: RLS enabled but no policies defined"),
    ("NOT rowsecurity AND wants_rls", "CONSIDER: Table may benefit from RLS"),
    ("rowsecurity", "OK: RLS properly configured"),
    default="STANDARD: No RLS required",
)
AUTH_STATUS = Ladder(
    ("passwordless_roles > 0", "CRITICAL: Passwordless accounts exist"), ("ssl <> 'on'", "WARNING: SSL not enforced"),
    ("password_encryption = 'md5'", "NOTICE: Consider upgrading to scram-sha-256"),
    default="OK: Basic authentication security configured",
)
AUTH_ADVICE = Ladder(
    ("passwordless_roles > 0", "Set passwords for all login roles: ALTER ROLE username PASSWORD 'secure_password';"),
    ("ssl <> 'on'", "Enable SSL in postgresql.conf: ssl = on"),
    ("password_encryption = 'md5'", "Upgrade password encryption: password_encryption = scram-sha-256"),
    default="Review pg_hba.conf for connection restrictions",
)
GRADE = Ladder(
    ("passwordless_count > 0 OR risky_functions > 0", "CRITICAL: Immediate security attention required"),
    ("superuser_count > 3 OR public_schema_tables > 10 OR tables_needing_rls > 5", "HIGH: Security hardening recommended"),
    ("superuser_count > 1 OR public_schema_tables > 0", "MEDIUM: Security improvements suggested"),
    default="GOOD: Basic security practices followed",
)
TABLE_PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE")

def passwordless() -> Column:
    return F.col("rolcanlogin") & F.col("rolpassword").isNull()




def named_roles(s: Snapshots) -> DataFrame:
    """Roles without the built-in ones. The pattern's underscore matches any character."""
    return s.roles.where(~F.col("rolname").like("pg_%"))


def memberships(s: Snapshots) -> DataFrame:
    """Direct memberships with names on both sides."""
    names = s.roles.select(*SNAP, "oid", "rolname")
    edges = s.auth_members.join(shuffled(names.select(*SNAP, F.col("oid").alias("member"), F.col("rolname").alias("member_name"))), [*SNAP, "member"])
    return edges.join(shuffled(names.select(*SNAP, F.col("oid").alias("roleid"), F.col("rolname").alias("role_name"))), [*SNAP, "roleid"])


@report("RC2", order="member, roleid")
def role_closure_pairs(s: Snapshots) -> DataFrame:
    return role_closure(s.auth_members)


@report("PA1", order="is_superuser desc, can_create_roles desc, can_login desc, role_name")
def role_risk(s: Snapshots) -> DataFrame:
    """Attributes and risk of every role, with how many members it has and how many roles it is in. ``PA1L`` names them."""
    edges = memberships(s)
    members = edges.groupBy(*SNAP, F.col("roleid").alias("oid")).agg(n_rows().alias("members"))
    groups = edges.groupBy(*SNAP, F.col("member").alias("oid")).agg(n_rows().alias("groups"))
    return named_roles(s).join(members, [*SNAP, "oid"], "left").join(groups, [*SNAP, "oid"], "left").select(
        *SNAP, F.col("rolname").alias("role_name"), F.col("rolsuper").alias("is_superuser"),
        F.col("rolinherit").alias("inherits_privileges"), F.col("rolcreaterole").alias("can_create_roles"),
        F.col("rolcreatedb").alias("can_create_databases"), F.col("rolcanlogin").alias("can_login"),
        F.col("rolreplication").alias("replication_privilege"), F.col("rolbypassrls").alias("bypasses_rls"),
        F.col("rolconnlimit").alias("connection_limit"),
        F.when(F.col("rolpassword").isNull(), "NO PASSWORD SET").otherwise("PASSWORD SET").alias("password_status"),
        F.col("rolvaliduntil").alias("password_expiry"), ROLE_RISK.column().alias("security_risk_level"),
        F.coalesce("members", F.lit(0)).alias("role_member_count"), F.coalesce("groups", F.lit(0)).alias("member_of_count"))


@report("PA1L", order="role_name, member_name")
def role_memberships(s: Snapshots) -> DataFrame:
    """Direct memberships in long form, complete for roles of any size."""
    return memberships(s).select(*SNAP, "role_name", "member_name")


@report("PA2")
def privileged_summary(s: Snapshots) -> DataFrame:
    roles = named_roles(s)
    counts = roles.groupBy(*SNAP).agg(
        F.count_if("rolsuper").alias("superuser_count"), F.count_if("rolcreaterole").alias("role_creators_count"),
        F.count_if("rolcreatedb").alias("db_creators_count"), F.count_if(passwordless()).alias("passwordless_login_roles"),
        F.count_if("rolbypassrls").alias("rls_bypass_roles"))
    return counts.select(
        *SNAP, "superuser_count", "role_creators_count", "db_creators_count", "passwordless_login_roles", "rls_bypass_roles",
        PRIVILEGED.column().alias("security_assessment"))


@report("PA2L", order="kind, role_name")
def privileged_roles(s: Snapshots) -> DataFrame:
    """Superusers and login roles without a password by name, complete whatever their number."""
    kinds = F.array_compact(F.array(F.when(F.col("rolsuper"), "superuser"), F.when(passwordless(), "passwordless")))
    return named_roles(s).select(*SNAP, F.col("rolname").alias("role_name"), F.explode(kinds).alias("kind"))


def effective_privileges(s: Snapshots, kind: str) -> DataFrame:
    """(role, object, privilege) held directly or through memberships; PUBLIC stays a grantee of its own.

    Rights pass to a member only if it inherits, and on through members that do.
    A grant to PUBLIC or a superuser's power reaches every role or object alike,
    so it is one row rather than one per pair; ``rights_of`` collects what one role may do.
    """
    direct = s.grants.where(F.col("object_kind") == kind).select(*SNAP, F.col("grantee").alias("role_name"), "object", "privilege").distinct()
    names = s.roles.select(*SNAP, "oid", "rolname")
    inheriting = s.roles.where("rolinherit").select(*SNAP, F.col("oid").alias("member"))
    closure = (
        role_closure(s.auth_members.join(inheriting, [*SNAP, "member"]))
        .join(names.select(*SNAP, F.col("oid").alias("member"), F.col("rolname").alias("member_name")), [*SNAP, "member"])
        .join(names.select(*SNAP, F.col("oid").alias("roleid"), F.col("rolname").alias("role_name")), [*SNAP, "roleid"]))
    inherited = direct.join(closure, [*SNAP, "role_name"]).select(*SNAP, F.col("member_name").alias("role_name"), "object", "privilege")
    return direct.unionByName(inherited)


def _holders(s: Snapshots, kind: str, owners: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Per (login role or PUBLIC, object): ownership, and one flag per privilege."""
    granted = effective_privileges(s, kind).withColumn("is_owner", F.lit(False))
    owned = owners.select(*SNAP, "role_name", "object", F.lit(None).cast("string").alias("privilege"), F.lit(True).alias("is_owner"))
    held = granted.unionByName(owned).groupBy(*SNAP, "role_name", "object").agg(
        F.bool_or("is_owner").alias("is_owner"),
        *[F.coalesce(F.bool_or(F.col("privilege") == p), F.lit(False)).alias(flag) for flag, p in flags.items()])
    # What everybody may do adds to what a role holds on the same object: one row per object, not per role.
    public = held.where(F.col("role_name") == "PUBLIC").select(*SNAP, "object", *[F.col(flag).alias(f"all_{flag}") for flag in flags])
    held = held.join(public, [*SNAP, "object"], "left").select(
        *SNAP, "role_name", "object", "is_owner", *[(F.col(flag) | F.coalesce(f"all_{flag}", F.lit(False))).alias(flag) for flag in flags])
    logins = named_roles(s).where("rolcanlogin").select(*SNAP, F.col("rolname").alias("role_name"), F.col("rolsuper").alias("is_super"))
    known = held.join(logins, [*SNAP, "role_name"], "left")
    everybody = F.col("role_name") == "PUBLIC"
    # A superuser is reported once for all objects, and once for each object it owns.
    listed = known.where(everybody | ~F.col("is_super") | (F.col("is_super") & F.col("is_owner")))
    super_ = F.coalesce("is_super", F.lit(False))
    plain = listed.select(*SNAP, "role_name", "object", "is_owner", *[(F.col(flag) | super_).alias(flag) for flag in flags], super_.alias("is_super"))
    supers = logins.where("is_super").select(
        *SNAP, "role_name", F.lit(ALL_OBJECTS).alias("object"), F.lit(False).alias("is_owner"),
        *[F.lit(True).alias(flag) for flag in flags], "is_super")
    return plain.unionByName(supers)


def rights_of(access: DataFrame, role: str) -> DataFrame:
    """Rows of an access report that apply to one role: its own, everybody's, and a superuser's row for all objects."""
    return access.where(F.col("role_name").isin(role, "PUBLIC"))


def _owner_names(s: Snapshots, objects: DataFrame, owner: str, object: str) -> DataFrame:
    names = s.roles.select(*SNAP, F.col("oid").alias(owner), F.col("rolname").alias("role_name"))
    return objects.select(*SNAP, F.col(object).alias("object"), owner).join(names, [*SNAP, owner])


@report("PA3", order="database_name, role_name")
def database_access(s: Snapshots) -> DataFrame:
    databases = s.database_stats.where(~F.col("datname").isin("template0", "template1"))
    owners = _owner_names(s, databases, "datdba", "datname")
    flags = {"can_connect": "CONNECT", "can_create": "CREATE", "can_temp": "TEMP"}
    held = _holders(s, "database", owners, flags).where("is_owner OR can_connect OR is_super")
    sizes = databases.select(*SNAP, F.col("datname").alias("object"), "size_bytes")
    yes = lambda c: F.when(F.col(c), "YES").otherwise("NO")
    return held.join(sizes, [*SNAP, "object"], "left").select(
        *SNAP, F.col("object").alias("database_name"), "role_name",
        F.when(F.col("is_owner"), "OWNER").when(F.col("can_connect"), "CONNECT").otherwise("NO ACCESS").alias("database_privilege"),
        yes("can_create").alias("can_create_schemas"), yes("can_temp").alias("can_create_temp_tables"),
        pretty_bytes("size_bytes").alias("database_size"), DATABASE_ACCESS.column().alias("access_description"))


@report("PA4", order="schema_name, role_name")
def schema_access(s: Snapshots) -> DataFrame:
    schemas = s.schemas.where(~F.col("schemaname").like("pg_%") & (F.col("schemaname") != "information_schema"))
    owners = _owner_names(s, schemas, "nspowner", "schemaname")
    held = _holders(s, "schema", owners, {"has_usage": "USAGE", "has_create": "CREATE"})
    tables = s.relations.where(F.col("relkind") == "r").groupBy(*SNAP, F.col("schemaname").alias("object")).agg(n_rows().alias("tables"))
    functions = s.functions.groupBy(*SNAP, F.col("schemaname").alias("object")).agg(n_rows().alias("functions"))
    zero = F.lit(0)
    return held.where("is_owner OR has_usage OR has_create OR is_super").join(tables, [*SNAP, "object"], "left").join(
        functions, [*SNAP, "object"], "left").withColumn("schema_name", F.col("object")).select(
        *SNAP, "schema_name", "role_name", "is_owner", "has_usage", "has_create", SCHEMA_ACCESS.column().alias("privilege_summary"),
        F.coalesce("tables", zero).alias("table_count"), F.coalesce("functions", zero).alias("function_count"))


def user_tables(s: Snapshots) -> DataFrame:
    """Tables and partitioned tables outside the system schemas, with size and rows."""
    stats = s.table_stats.select(*SNAP, F.col("relid").alias("oid"), "n_live_tup", "total_relation_size")
    return s.relations.where(F.col("relkind").isin("r", "p") & ~F.col("schemaname").isin(*SYSTEM_SCHEMAS)).join(
        stats, [*SNAP, "oid"], "left")


@report("PA5", order="data_sensitivity, table_name, role_name")
def table_access(s: Snapshots) -> DataFrame:
    tables = user_tables(s).withColumn("object", F.col("oid").cast("string"))
    owners = tables.select(*SNAP, "object", F.col("owner").alias("role_name"))
    flags = {f"can_{p.lower()}": p for p in TABLE_PRIVILEGES}
    held = _holders(s, "table", owners, flags).where(
        "is_owner OR can_select OR can_insert OR can_update OR can_delete OR is_super")
    # What depends on the table alone is worked out once per table, before it meets its many roles.
    facts = tables.withColumn("is_sensitive", matches_ci("table_name", SENSITIVE)).withColumn("estimated_rows", F.col("n_live_tup")).select(
        *SNAP, "object", qualified().alias("full_name"), "owner", "estimated_rows",
        pretty_bytes("total_relation_size").alias("table_size"), SENSITIVITY.column().alias("data_sensitivity"))
    known = held.join(facts, [*SNAP, "object"], "left").where(F.col("full_name").isNotNull() | (F.col("object") == ALL_OBJECTS))
    words = F.concat(*[F.when(F.col(flag), p + " ").otherwise("") for flag, p in flags.items()])
    return known.select(
        *SNAP, F.coalesce("full_name", "object").alias("table_name"), F.col("owner").alias("table_owner"), "role_name",
        words.alias("table_privileges"), "table_size", "estimated_rows",
        F.coalesce("data_sensitivity", F.lit(SENSITIVITY.default)).alias("data_sensitivity"), TABLE_RISK.column().alias("risk_assessment"))


@report("PA6", order="schema_name, function_name")
def function_risk(s: Snapshots) -> DataFrame:
    return s.functions.where(~F.col("schemaname").isin(*SYSTEM_SCHEMAS)).withColumn("admin_name", matches_ci("proname", ADMIN_NAMES)).select(
        *SNAP, F.col("schemaname").alias("schema_name"), F.col("proname").alias("function_name"), F.col("owner").alias("function_owner"),
        F.when(F.col("prosecdef"), "SECURITY DEFINER").otherwise("SECURITY INVOKER").alias("security_mode"),
        F.when(F.col("public_execute"), "PUBLIC EXECUTE").otherwise("RESTRICTED ACCESS").alias("access_control"),
        F.col("arguments").alias("function_arguments"), F.col("result_type").alias("return_type"),
        FUNCTION_RISK.column().alias("security_risk"), FUNCTION_ADVICE.column().alias("security_recommendation"))


@report("PA7", order="rls_enabled desc, table_name")
def rls_audit(s: Snapshots) -> DataFrame:
    policies = s.policies.groupBy(*SNAP, F.col("polrelid").alias("oid")).agg(n_rows().alias("policies"))
    return user_tables(s).join(policies, [*SNAP, "oid"], "left").withColumn("policy_count", F.coalesce("policies", F.lit(0))).withColumn(
        "wants_rls", matches_ci("table_name", RLS_SENSITIVE)).select(
        *SNAP, qualified().alias("table_name"), F.col("rowsecurity").alias("rls_enabled"),
        F.when(F.col("rowsecurity"), "ENABLED").otherwise("DISABLED").alias("rls_status"), "policy_count",
        RLS.column().alias("rls_assessment"), pretty_bytes("total_relation_size").alias("table_size"), F.col("n_live_tup").alias("estimated_rows"))


@report("PA8")
def authentication_summary(s: Snapshots) -> DataFrame:
    counts = s.roles.groupBy(*SNAP).agg(
        F.count_if("rolcanlogin").alias("total_login_roles"), F.count_if(passwordless()).alias("passwordless_roles"),
        F.count_if(F.col("rolcanlogin") & (F.col("rolvaliduntil") < F.col("snap_ts"))).alias("expired_password_roles"),
        F.count_if("rolsuper").alias("superuser_roles"))
    return counts.join(pivot_settings(s.settings, "password_encryption", "ssl"), SNAP, "left").select(
        *SNAP, "total_login_roles", "passwordless_roles", "expired_password_roles", "superuser_roles",
        F.col("password_encryption").alias("password_encryption_method"), F.col("ssl").alias("ssl_enabled"),
        AUTH_STATUS.column().alias("security_status"), AUTH_ADVICE.column().alias("primary_recommendation"))


def security_metrics(s: Snapshots) -> DataFrame:
    roles = s.roles.groupBy(*SNAP).agg(F.count_if("rolsuper").alias("superuser_count"), F.count_if(passwordless()).alias("passwordless_count"))
    tables = s.relations.where(F.col("relkind").isin("r", "p")).groupBy(*SNAP).agg(
        F.count_if(F.col("schemaname") == "public").alias("public_schema_tables"),
        F.count_if(~F.col("rowsecurity") & matches_ci("table_name", RLS_SENSITIVE)).alias("tables_needing_rls"))
    functions = s.functions.where(~F.col("schemaname").isin(*SYSTEM_SCHEMAS)).groupBy(*SNAP).agg(
        F.count_if(F.col("prosecdef") & F.col("public_execute")).alias("risky_functions"))
    return roles.join(tables, SNAP, "left").join(functions, SNAP, "left").fillna(
        0, ["public_schema_tables", "tables_needing_rls", "risky_functions"])


@report("PA9")
def security_grade(s: Snapshots) -> DataFrame:
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    return security_metrics(s).select(
        *SNAP, count("superuser_count", " superuser accounts").alias("superuser_status"),
        count("passwordless_count", " passwordless login roles").alias("authentication_status"),
        count("public_schema_tables", " tables in public schema").alias("schema_security_status"),
        count("risky_functions", " high-risk SECURITY DEFINER functions").alias("function_security_status"),
        count("tables_needing_rls", " sensitive tables without RLS").alias("rls_status"), GRADE.column().alias("overall_security_grade"))
