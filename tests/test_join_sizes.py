"""Sides that grow with the tables are never collected on the driver, however small Spark guesses them to be."""

import re

import pytest

from fleetstat.plans import registry
from fleetstat.sources.snapshots import Snapshots, schema_of

AT = "timestamp'2024-01-31' snap_ts"


def strategies(df):
    """Joins of the plan as it ran."""
    df.collect()
    return re.findall(r"\b(Broadcast\w*Join|SortMergeJoin|ShuffledHashJoin)\b", df._jdf.queryExecution().executedPlan().toString())


def test_settings_are_not_sent_to_every_task(spark):
    servers = spark.sql(f"""SELECT server_id, {AT}, ram * 1073741824L ram_bytes, workload FROM
        VALUES (1L, 16L, 'oltp'), (2L, 4L, 'none'), (NULL, 4L, 'olap') t(server_id, ram, workload)""")
    settings = spark.sql(f"""SELECT server_id, {AT}, name, setting, unit, source FROM
        VALUES (1L, 'work_mem', '1024', 'kB', 'default'), (1L, 'work_mem', '4096', 'kB', 'user'), (1L, 'port', '5432', NULL, 'user'),
               (2L, 'max_connections', '300', NULL, 'user'), (NULL, 'work_mem', '64', 'kB', 'user') t(server_id, name, setting, unit, source)""")
    df = registry.run("PT2", Snapshots.from_frames(spark, servers=servers, settings=settings))
    assert set(strategies(df)) == {"SortMergeJoin"}
    rows = [(r.server_id, r.name, r.current_value, r.recommended, r.note) for r in df.collect()]
    assert sorted(r[2:] for r in rows if r[:2] == (1, "work_mem")) == [
        ("1024kB", "20MB", "Consider increasing for complex queries"), ("4096kB", "20MB", None)]
    assert [r[2:] for r in rows if r[:2] == (2, "max_connections")] == [("300", "100", "Consider connection pooling")]
    assert [r[2:] for r in rows if r[:2] == (2, "work_mem")] == [(None, "10MB", None)]  # a setting the server lacks
    assert {r[2] for r in rows if r[0] is None} == {None} and not [r for r in rows if r[1] == "port"]


def indexed(spark):
    """Two tables; an index on two columns of which one has no statistics, and one whose table is not known."""
    none = spark.sql(f"SELECT 1L server_id, {AT} WHERE false")
    return Snapshots.from_frames(
        spark, locks=none, servers=none, repl_stats=none,
        activity=spark.sql(f"SELECT server_id, {AT}, id pid, state FROM VALUES (1L, 1L, 'active'), (1L, 2L, 'idle in transaction'), (2L, 3L, 'active') t(server_id, id, state)"),
        settings=spark.sql(f"SELECT server_id, {AT}, 'max_connections' name, '10' setting FROM VALUES (1L), (3L) t(server_id)"),
        table_stats=spark.sql(f"SELECT 1L server_id, {AT}, relid, 's' schemaname, name table_name, n_live_tup FROM VALUES (1L, 'a', 1000L), (2L, 'b', 0L) t(relid, name, n_live_tup)"),
        index_stats=spark.sql(f"""SELECT 1L server_id, {AT}, relid, 's' schemaname, name table_name, index_name, size index_size, 'ON t (' || cols || ')' indexdef FROM
            VALUES (1L, 'a', 'two', 1048576L, 'x, y'), (2L, 'b', 'one', 8192L, 'x'), (3L, 'c', 'lost', 8192L, 'x') t(relid, name, index_name, size, cols)"""),
        column_stats=spark.sql(f"SELECT 1L server_id, {AT}, relid, attname, width avg_width FROM VALUES (1L, 'x', 100L), (2L, 'x', 4L) t(relid, attname, width)"))


def test_samples_of_alerts_are_not_sent_to_every_task(spark):
    from fleetstat.plans import checks
    df = checks.alert_samples(indexed(spark), {"idle_in_transaction_percent", "index_bloat_percent", "pool_efficiency_percent"})
    assert set(strategies(df)) == {"SortMergeJoin"}
    got = {(r.server_id, r.metric, r.object): r.value for r in df.collect()}
    assert got[1, "connection_percent", "server"] == 20.0 and (2, "connection_percent", "server") not in got
    assert got[2, "pool_efficiency_percent", "server"] == 100.0 and (1, "index_bloat_percent", "two") in got


def test_derived_tables_are_not_sent_to_every_task(spark, tmp_path):
    spark.sql("""SELECT p_partkey, 'a b' p_name, 'B' p_brand, 'TYPE' p_type, 3 p_size, 1.0D p_retailprice FROM
        VALUES (10L), (11L), (NULL) t(p_partkey)""").write.parquet(str(tmp_path / "part.parquet"))
    spark.sql("""SELECT 1L l_orderkey, k l_partkey, 1L l_suppkey, n l_linenumber, 5.0D l_quantity FROM
        VALUES (10L, 1), (10L, 2), (12L, 1), (NULL, 1) t(k, n)""").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = Snapshots.from_tables(spark, str(tmp_path)).table_stats
    assert set(strategies(df)) == {"SortMergeJoin"}
    assert [(r.relid, r.table_name, r.n_live_tup, r.n_tup_ins) for r in df.collect()] == [(10, "user_a_b_10", 30, 150)]


def test_widths_of_indexed_columns_are_not_sent_to_every_task(spark):
    df = registry.run("IB1", indexed(spark))
    assert set(strategies(df)) == {"SortMergeJoin"}
    got = {r.index_name: (r.row_count, r.key_width, r.expected_bytes) for r in df.collect()}
    assert got == {"two": (1000, 112, 18 * 8192), "one": (0, 8, 8192)}  # 104 for x, 8 for y without statistics; 59 rows a page


def test_foreign_keys_are_not_sent_to_every_task(spark):
    keys = "VALUES (1L, 'f1', 'a', 'x'), (1L, 'f2', 'a', 'y'), (2L, 'f3', 'b', 'x'), (NULL, 'f4', 'a', 'x')"
    of = lambda columns, rows: spark.sql(f"SELECT server_id, {AT}, {columns} FROM {rows}")
    df = registry.run("MI2", Snapshots.from_frames(
        spark,
        table_constraints=of("n constraint_name, 's' table_schema, tab table_name, 'FOREIGN KEY' constraint_type", f"{keys} t(server_id, n, tab, col)"),
        key_columns=of("n constraint_name, 's' table_schema, col column_name", f"{keys} t(server_id, n, tab, col)"),
        constraint_columns=of("n constraint_name, 's' table_schema, 'r' ref_table, 'id' ref_column", f"{keys} t(server_id, n, tab, col)"),
        index_stats=of("'s' schemaname, 'a' table_name, i index_name, '(' || col || ')' indexdef", "VALUES (1L, 'i1', 'x'), (1L, 'i2', 'x, z'), (2L, 'i3', 'x') t(server_id, i, col)"),
        table_stats=of("'s' schemaname, tab table_name, 5L n_live_tup", "VALUES (1L, 'a'), (3L, 'b') t(server_id, tab)")))
    assert set(strategies(df)) == {"SortMergeJoin"}
    got = sorted((r.server_id, r.fk_column, r.index_status[:8], r.index_status.split()[-1], r.estimated_rows) for r in df.collect())
    assert got == [(1, "x", "EXISTS: ", "i1", 5), (1, "x", "EXISTS: ", "i2", 5), (1, "y", "MISSING:", "column", 5), (2, "x", "MISSING:", "column", None)]


def test_parts_of_the_findings_are_not_sent_to_every_task(spark):
    from fleetstat.plans import connections, indexes, security, servers
    s = Snapshots.from_frames(
        spark,
        activity=spark.sql(f"SELECT server_id, {AT}, 'active' state FROM VALUES (1L), (1L), (2L) t(server_id)"),
        settings=spark.sql(f"""SELECT server_id, {AT}, name, setting FROM
            VALUES (1L, 'max_connections', '10'), (1L, 'archive_mode', 'on'), (2L, 'archive_mode', 'off') t(server_id, name, setting)"""),
        archiver=spark.sql(f"SELECT server_id, {AT}, 2L failed_count, {AT.split()[0]} last_failed_time FROM VALUES (1L), (9L) t(server_id)"),
        servers=spark.sql(f"SELECT server_id, {AT}, '1/0' current_lsn FROM VALUES (1L), (2L) t(server_id)"),
        repl_slots=spark.sql(f"SELECT server_id, {AT}, '0/0' restart_lsn, false active FROM VALUES (1L) t(server_id)"),
        database_stats=spark.sql(f"SELECT server_id, {AT}, 5L xid_age FROM VALUES (1L), (2L) t(server_id)"),
        roles=spark.sql(f"SELECT 1L server_id, {AT}, oid, rolname FROM VALUES (1L, 'a'), (2L, 'b'), (3L, 'c') t(oid, rolname)"),
        auth_members=spark.sql(f"SELECT 1L server_id, {AT}, roleid, member FROM VALUES (1L, 2L), (1L, 3L), (1L, 8L), (NULL, 2L) t(roleid, member)"),
        table_stats=spark.sql(f"SELECT 1L server_id, {AT}, relid, 7L n_live_tup FROM VALUES (1L), (1L) t(relid)"),
        index_stats=spark.sql(f"SELECT 1L server_id, {AT}, relid, 's' schemaname, 4194304L index_size, 0L idx_scan FROM VALUES (1L), (2L) t(relid)"))
    used = connections.connection_utilization(s)
    assert set(strategies(used)) == {"SortMergeJoin"}
    assert {r.server_id: r.connection_utilization_percent for r in used.collect()} == {1: 20.0, 2: None}
    unused = indexes.unused_indexes(s)
    assert set(strategies(unused)) == {"SortMergeJoin"}
    assert sorted((r.times_used, r.table_rows) for r in unused.where("table_rows IS NOT NULL").collect()) == [(0, 7), (0, 7)] and unused.count() == 3
    members = security.memberships(s)
    assert set(strategies(members)) == {"SortMergeJoin"}
    assert sorted((r.member_name, r.role_name) for r in members.collect()) == [("b", "a"), ("c", "a")]
    ready = servers.backup_readiness(s)
    assert "SortMergeJoin" in strategies(ready) and sorted(r.server_id for r in ready.collect()) == [1, 2]


def numbered(spark, relation):
    """Two rows of a relation, each value made from the row's number."""
    def value(f):
        kind = f.dataType.typeName()
        made = {"string": f"concat('{f.name}', id)", "boolean": "id % 2 = 0", "timestamp": "timestamp'2024-01-31'"}.get(kind)
        return f"cast({made or ('id' if kind in ('long', 'integer', 'double') else 'null')} as {f.dataType.simpleString()}) {f.name}"
    return spark.range(1, 3).selectExpr(*map(value, schema_of(relation)))


@pytest.mark.parametrize("id", ["CK1", "CK6", "S7L"])
def test_whole_reports_send_no_growing_side_to_every_task(spark, id):
    df = registry.run(id, Snapshots(spark, lambda relation: numbered(spark, relation)))
    plan = df._jdf.queryExecution().executedPlan().toString()  # before it runs: what Spark's guesses choose
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}
    assert not [k for k in keys if re.search("relid|member|roleid|constraint_name|table_name", k)]
    assert df.count() > 0
