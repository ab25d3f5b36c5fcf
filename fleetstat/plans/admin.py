"""Constraints, extensions and ownership; referential checks on data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import EXTENSION_SCHEMAS, SNAP, SYSTEM_SCHEMAS, Ladder, pretty_bytes, qualified, user_schema
from fleetstat.operators.joins import validate_foreign_key
from fleetstat.plans.indexes import foreign_keys_of
from fleetstat.plans.registry import report
from fleetstat.sources.snapshots import Snapshots

# Relation kinds, watched extensions, expected owners.
RELATION_KIND = Ladder.lookup("relkind", {
    "r": "TABLE", "v": "VIEW", "m": "MATERIALIZED VIEW", "f": "FOREIGN TABLE", "p": "PARTITIONED TABLE"}, None)
RISKY_EXTENSIONS = ("dblink", "postgres_fdw", "file_fdw", "adminpack")
EXPECTED_OWNERS = ("app_user", "service_account")
SAFE_EXTENSIONS = ("plpgsql",)


@report("AD1", order="source_table, constraint_name")
def foreign_keys(s: Snapshots) -> DataFrame:
    on = [*SNAP, "constraint_name", "table_schema"]
    rules = s.referential_constraints.select(*on, "delete_rule", "update_rule")
    return foreign_keys_of(s).join(rules, on).select(
        *SNAP, "constraint_name", qualified("table_schema", "table_name").alias("source_table"),
        F.col("column_name").alias("source_column"), qualified("table_schema", "ref_table").alias("referenced_table"),
        F.col("ref_column").alias("referenced_column"), F.col("delete_rule").alias("on_delete"), F.col("update_rule").alias("on_update"))


@report("AD2", order="size_bytes desc")
def non_hypertables(s: Snapshots) -> DataFrame:
    on = [*SNAP, "schemaname", "table_name"]
    plain = s.table_stats.where(~F.col("schemaname").isin(*SYSTEM_SCHEMAS, *EXTENSION_SCHEMAS))
    return plain.join(s.hypertables.select(*on), on, "left_anti").select(
        *on, F.col("total_relation_size").alias("size_bytes"), pretty_bytes("total_relation_size").alias("size"),
        F.col("n_live_tup").alias("estimated_rows"))


@report("AD3", order="name")
def available_extensions(s: Snapshots) -> DataFrame:
    return s.available_extensions.select(*SNAP, "name", "default_version", "installed_version", "comment")


@report("AD4", order="extension_name")
def installed_extensions(s: Snapshots) -> DataFrame:
    return s.extensions.select(
        *SNAP, F.col("extname").alias("extension_name"), F.col("extversion").alias("version"), F.col("schemaname").alias("schema"), "description")


@report("AD5", order="schema_name, table_name")
def table_ownership(s: Snapshots) -> DataFrame:
    kinds = s.relations.where(user_schema("schemaname")).withColumn("table_type", RELATION_KIND.column())
    return kinds.where(F.col("table_type").isNotNull()).select(*SNAP, F.col("schemaname").alias("schema_name"), "table_name", "owner", "table_type")


@report("AD6", order="schemaname, table_name")
def unexpected_owners(s: Snapshots, allowed: tuple[str, ...] = EXPECTED_OWNERS) -> DataFrame:
    tables = s.relations.where(F.col("relkind").isin("r", "p") & ~F.col("schemaname").isin(*SYSTEM_SCHEMAS))
    return tables.where(~F.col("owner").isin(*allowed)).select(*SNAP, "schemaname", "table_name", "owner")


@report("AD7")
def public_grants(s: Snapshots) -> DataFrame:
    return s.grants.where(F.upper("grantee") == "PUBLIC").select(*SNAP, "grantee", "object_kind", "object", "privilege")


@report("AD8", order="extname")
def risky_extensions(s: Snapshots) -> DataFrame:
    return s.extensions.where(F.col("extname").isin(*RISKY_EXTENSIONS)).select(*SNAP, "extname", "extversion")


@report("AD8R", order="rolname")
def extension_owner_roles(s: Snapshots) -> DataFrame:
    owners = s.extensions.where(~F.col("extname").isin(*SAFE_EXTENSIONS)).select(*SNAP, F.col("owner").alias("rolname"))
    return s.roles.join(owners, [*SNAP, "rolname"], "left_semi").select(*SNAP, "rolname", "rolsuper", "rolcreaterole", "rolcreatedb")


@report("AD9", order="schemaname, table_name")
def tables_without_primary_key(s: Snapshots) -> DataFrame:
    on = [*SNAP, "schemaname", "table_name"]
    keyed = s.table_constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(
        *SNAP, F.col("table_schema").alias("schemaname"), "table_name")
    tables = s.relations.where(F.col("relkind").isin("r", "p") & ~F.col("schemaname").isin(*SYSTEM_SCHEMAS)).select(*on)
    return tables.join(keyed, on, "left_anti")


@report("AD10", order="constraint_name")
def fk_prefix_index_missing(s: Snapshots) -> DataFrame:
    """Foreign keys no index starts with. Leading column lists of every length are matched by equality."""
    prefixes = s.index_stats.select(
        *SNAP, F.col("schemaname").alias("table_schema"), "table_name",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("indkey")), lambda n: F.slice("indkey", F.lit(1), n))).alias("conkey")).distinct()
    keys = foreign_keys_of(s).groupBy(*SNAP, "constraint_name", "table_schema", "table_name").agg(
        F.sort_array(F.collect_list("column_position")).alias("conkey"))
    return keys.join(prefixes, [*SNAP, "table_schema", "table_name", "conkey"], "left_anti").select(
        *SNAP, "constraint_name", qualified("table_schema", "table_name").alias("table_name"),
        F.array_join(F.col("conkey").cast("array<string>"), ",").alias("columns"))


@report("AD11", order="size_bytes desc")
def hypertable_sizes(s: Snapshots) -> DataFrame:
    on = [*SNAP, "schemaname", "table_name"]
    return s.hypertables.select(*on, "num_chunks").join(s.table_stats.select(*on, "total_relation_size"), on).select(
        *on, "num_chunks", F.col("total_relation_size").alias("size_bytes"), pretty_bytes("total_relation_size").alias("size"))


# --- referential integrity of stored data ------------------------------------------

@report("J14_ORDERS")
def validate_orders_customer(s: Snapshots) -> DataFrame:
    return validate_foreign_key(s.orders, s.customer, ["o_custkey"], ["c_custkey"])


@report("J14_LINEITEM")
def validate_lineitem_orders(s: Snapshots) -> DataFrame:
    return validate_foreign_key(s.lineitem, s.orders, ["l_orderkey"], ["o_orderkey"])


@report("J14_LABELS")
def validate_labels_documents(s: Snapshots) -> DataFrame:
    return validate_foreign_key(s.labels, s.documents, ["doc_id"], ["doc_id"])


@report("J14_MEMBERS")
def validate_members_roles(s: Snapshots) -> DataFrame:
    """Memberships of roles that the server no longer has."""
    return validate_foreign_key(s.auth_members, s.roles, ["server_id", "roleid"], ["server_id", "oid"])
