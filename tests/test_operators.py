"""Joins, graphs, history and storage on small frames, against brute force where it matters."""

import datetime as dt
import os
import tempfile
from itertools import product

import pytest
from pyspark.sql import functions as F

from fleetstat.operators import graphs, history, joins, profile, ranking
from fleetstat.plans import registry
from fleetstat.sources import sinks
from fleetstat.sources.snapshots import Snapshots, conform, read_snapshot

T0 = dt.datetime(2024, 1, 1)


def test_pairs_with_a_hot_object_match_brute_force(spark, monkeypatch):
    """One object holds most locks; another has only NULL names; one waiter has no session."""
    locks = [(1, T0, pid, "relation", 7, mode, granted) for pid, mode, granted in
             [(i, "ShareLock", i % 3 != 0) for i in range(60)]] + [
        (1, T0, 100, "transactionid", None, "ExclusiveLock", True), (1, T0, 101, "transactionid", None, "ShareLock", False),
        (1, T0, 999, "relation", 7, "ShareLock", False), (2, T0, 5, "relation", 7, "ShareLock", False)]
    activity = [(sid, T0, pid, f"u{pid}") for sid, pid in [(1, i) for i in range(60)] + [(1, 100), (1, 101), (2, 5)]]
    s = Snapshots.from_frames(
        spark,
        locks=spark.createDataFrame(locks, "server_id long, snap_ts timestamp, pid long, locktype string, relation long, mode string, granted boolean"),
        activity=spark.createDataFrame(activity, "server_id long, snap_ts timestamp, pid long, usename string"))
    known = {(a[0], a[2]) for a in activity}
    expected = sorted(
        (w[2], h[2]) for w, h in product(locks, locks)
        if not w[6] and w[0] == h[0] and w[3:5] == h[3:5] and w[2] != h[2] and (w[0], w[2]) in known and (h[0], h[2]) in known)
    waits = ~F.col("granted")
    for cell, grid in ((4096, []), (7, [(3, 9)]), (1, [(21, 61)])):  # one cell, a grid, a cell for each row
        monkeypatch.setattr(joins, "CELL", cell)
        sizes = joins.hot_keys(s.locks.where("relation = 7 AND server_id = 1"), ["server_id", "relation"], waits, F.lit(True))
        assert [(r["_lines"], r["_columns"]) for r in sizes.collect()] == grid
        found = registry.run("LK2", s).select("blocked_pid", "blocking_pid").collect()
        assert sorted(tuple(r) for r in found) == expected
    blocked = sorted(r.pid for r in joins.blocked_sessions(s.locks, s.activity).collect())
    assert blocked == sorted({w for w, _ in expected})


def test_top_k_is_per_snapshot_and_deterministic(spark):
    df = spark.createDataFrame([(1, T0, i, i % 2) for i in range(10)] + [(2, T0, i, 0) for i in range(3)], "server_id long, snap_ts timestamp, id long, v long")
    got = ranking.top_k(df, 4, F.col("v").desc(), F.col("id").asc()).select("server_id", "id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (1, 3), (1, 5), (1, 7), (2, 0), (2, 1), (2, 2)]


def test_closure_handles_cycles_and_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100)]
    df = spark.createDataFrame([(1, T0, m, r) for m, r in edges], "server_id long, snap_ts timestamp, member long, roleid long")
    got = {(r.member, r.roleid) for r in graphs.role_closure(df).collect()}
    expected = {(i, j) for i in range(21) for j in range(i + 1, 21)} | set(product((100, 101, 102), repeat=2))
    assert got == expected


def test_tree_walk_reaches_every_level_and_names_what_no_root_leads_to(spark):
    rows = [(0, None)] + [(i + 1, i) for i in range(15)] + [(50, 51), (51, 50), (60, 99), (61, 60)]
    df = spark.createDataFrame([(1, T0, o, p, str(o)) for o, p in rows], "server_id long, snap_ts timestamp, oid long, parent_oid long, name string")
    got = {(r.oid, r.level) for r in graphs.walk_tree(df).collect()}
    assert got == {(i, i) for i in range(16)} | {(o, None) for o in (50, 51, 60, 61)}


def test_a_role_of_many_members_is_whole(spark):
    from fleetstat.plans import security
    n = 20_000
    roles = spark.range(n + 1).selectExpr(
        "1L server_id", "timestamp'2024-01-31' snap_ts", "id oid", "concat('r', id) rolname", "false rolsuper", "true rolinherit", "false rolcreaterole",
        "false rolcreatedb", "true rolcanlogin", "false rolreplication", "false rolbypassrls", "-1 rolconnlimit", "'x' rolpassword", "cast(null as timestamp) rolvaliduntil")
    edges = spark.range(1, n + 1).selectExpr("1L server_id", "timestamp'2024-01-31' snap_ts", "0L roleid", "id member")
    s = Snapshots.from_frames(spark, roles=roles, auth_members=edges)
    assert security.role_risk(s).where("role_name = 'r0'").first().role_member_count == n
    assert security.role_memberships(s).count() == n


def test_rights_stop_at_a_member_that_does_not_inherit(spark):
    from fleetstat.plans import security
    at = "timestamp'2024-01-31' snap_ts"
    roles = spark.sql(f"""SELECT 1L server_id, {at}, oid, rolname, rolsuper, rolinherit, true rolcanlogin FROM
        VALUES (1L, 'a', false, true), (2L, 'b', false, false), (3L, 'c', false, true), (4L, 's', true, true) t(oid, rolname, rolsuper, rolinherit)""")
    members = spark.sql(f"SELECT 1L server_id, {at}, * FROM VALUES (1L, 2L), (2L, 3L) t(member, roleid)")
    grants = spark.sql(f"""SELECT 1L server_id, {at}, * FROM VALUES ('c', 'table', '9', 'SELECT'), ('b', 'table', '9', 'INSERT'), ('PUBLIC', 'table', '9', 'DELETE')
        t(grantee, object_kind, object, privilege)""")
    owners = spark.sql(f"SELECT 1L server_id, {at}, 's' role_name, '9' object")
    held = security._holders(Snapshots.from_frames(spark, roles=roles, auth_members=members, grants=grants), "table", owners, {"s": "SELECT", "i": "INSERT", "d": "DELETE"})
    got = {(r.role_name, r.object): (r.is_owner, r.s, r.i, r.d) for r in held.collect()}
    assert got == {("a", "9"): (False, False, True, True), ("b", "9"): (False, False, True, True), ("c", "9"): (False, True, False, True),
                   ("PUBLIC", "9"): (False, False, False, True), ("s", "9"): (True, True, True, True), ("s", security.ALL_OBJECTS): (False, True, True, True)}


def test_counter_delta_resets_and_bucket_borders(spark):
    times = [T0, T0 + dt.timedelta(hours=23), T0 + dt.timedelta(hours=25), T0 + dt.timedelta(days=4), T0 + dt.timedelta(days=4, minutes=1)]
    values = [10, 15, 25, 5, 5]
    df = spark.createDataFrame([(1, t, v, T0 if i < 4 else T0 + dt.timedelta(days=4)) for i, (t, v) in enumerate(zip(times, values))],
                               "server_id long, snap_ts timestamp, v long, stats_reset timestamp")
    plain = history.counter_delta(df, ["server_id"], ["v"]).orderBy("snap_ts").collect()
    assert [r.v_delta for r in plain] == [None, 5, 10, 5, 0]
    marked = history.counter_delta(df, ["server_id"], ["v"], stats_reset="stats_reset").orderBy("snap_ts").collect()
    assert [r.v_delta for r in marked] == [None, 5, 10, 5, 5]


def test_snapshot_diff_keeps_one_sided_objects(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    a = spark.createDataFrame([("b", 5), ("c", 7)], "k string, v long")
    got = {tuple(r) for r in joins.snapshot_diff(b, a, ["k"], ["v"]).collect()}
    assert got == {("a", 1, None, None), ("b", 2, 5, 3), ("c", None, 7, None)}


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(2,)], "id int")
    assert [tuple(r) for r in joins.validate_foreign_key(child, parent, ["k"], ["id"]).collect()] == [(1, 2)]


def test_profile_details(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else None, i * 2.0) for i in range(10)], "id long, t string, d double")
    got = {r.attname: r for r in profile.column_profile(df, "t", exact=True).collect()}
    assert (got["id"].n_distinct, got["t"].n_distinct, got["t"].null_frac, got["t"].top_frequency) == (-1, 1, 0.5, 5)


def test_distinct_struct_counts_rows_with_nulls(spark):
    s = Snapshots.from_frames(spark, activity=spark.createDataFrame(
        [(1, T0, 1, "d", None), (1, T0, 2, "d", "u")], "server_id long, snap_ts timestamp, pid long, datname string, usename string"))
    assert registry.run("CP7", s).first().unique_db_user_combinations == 2


def test_conform_names_missing_columns_and_fills_optional(spark):
    df = spark.createDataFrame([(1,)], "server_id long")
    with pytest.raises(ValueError, match="snap_ts"):
        conform(df, "locks")
    root = tempfile.mkdtemp(prefix="fleetstat-test-")
    full = Snapshots.from_tables(spark, "/root/testdata/sf0.001").statements.drop("jit_functions")
    full.write.parquet(os.path.join(root, "statements"))
    read = read_snapshot(spark, os.path.join(root, "statements"), "statements")
    assert read.where("jit_functions IS NOT NULL").count() == 0 and read.count() == full.count()
    stored = Snapshots.from_path(spark, root)
    assert registry.run("QP10", stored).count() == 0


def test_empty_relations_give_empty_reports(spark):
    s = Snapshots.from_frames(spark, statements=spark.createDataFrame([], "server_id long"), table_stats=spark.createDataFrame([], "server_id long"))
    for id in ("QP1", "QP2", "QP12", "MS5", "BL1", "HU3"):
        assert registry.run(id, s).count() == 0


def test_reports_can_be_ordered(spark):
    s = Snapshots.from_tables(spark, "/root/testdata/sf0.001")
    times = [r.total_time_ms for r in registry.run("qp2_top_by_total_time", s, ordered=True).collect()]
    assert times == sorted(times, reverse=True)


def test_retention_and_findings_files(spark):
    root = tempfile.mkdtemp(prefix="fleetstat-test-")
    as_of = dt.datetime(2024, 3, 1)
    df = spark.createDataFrame([(1, as_of - dt.timedelta(days=d), 100 + d) for d in (0, 7, 8, 30, 31)], "server_id long, snap_ts timestamp, size_bytes long")
    tiers = {r.size_bytes - 100: r.tier for r in sinks.retention_tiers(df, F.lit(as_of)).collect()}
    assert tiers == {0: "KEEP", 7: "KEEP", 8: "COMPRESS", 30: "COMPRESS", 31: "DELETE"}
    sinks.apply_retention(df, f"{root}/kept", F.lit(as_of))
    assert sorted(r.size_bytes - 100 for r in spark.read.parquet(f"{root}/kept").collect()) == [0, 7, 8, 30]
    sinks.write_findings(df, f"{root}/findings")
    sinks.write_findings(df, f"{root}/findings")
    sinks.write_findings(df.where("size_bytes = 100").withColumn("snap_ts", F.expr("snap_ts + interval 1 hour")), f"{root}/findings")
    assert spark.read.parquet(f"{root}/findings").count() == 6
    later = F.lit(as_of + dt.timedelta(days=1))
    assert sinks.apply_retention(df, f"{root}/kept", later) == ["2024-01-31"]
    assert sorted(r.size_bytes - 100 for r in spark.read.parquet(f"{root}/kept").collect()) == [0, 7, 8]
    dense = [f for f in os.listdir(f"{root}/kept/snap_date=2024-02-23") if ".zstd." in f]
    assert dense and all(".zstd." in f for f in os.listdir(f"{root}/kept/snap_date=2024-02-23") if f.startswith("part-"))
    sinks.write_csv(df.drop("snap_ts"), f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 5


def test_retention_takes_late_rows_and_leaves_the_rest(spark):
    """Rows that arrive for a day already stored are written; unchanged days keep their files; a lost manifest does no harm."""
    path = tempfile.mkdtemp(prefix="fleetstat-test-") + "/kept"
    as_of = dt.datetime(2024, 3, 1, 12)
    noon = [(1, as_of - dt.timedelta(days=d), d, {"k": d}, None) for d in (0, 1, 9)]
    late = [(1, as_of - dt.timedelta(hours=h), 100 + h, {}, "x") for h in (-5, 26)] + [(2, as_of - dt.timedelta(days=9, hours=2), 109, None, None)]
    schema = "server_id long, snap_ts timestamp, v long, props map<string,int>, note string"
    files = lambda: {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.startswith("part-")) for d in os.listdir(path) if d.startswith("snap_date")}
    sinks.apply_retention(spark.createDataFrame(noon, schema), path, F.lit(as_of))
    first = files()
    sinks.apply_retention(spark.createDataFrame(noon, schema).repartition(3), path, F.lit(as_of))
    assert files() == first
    sinks.apply_retention(spark.createDataFrame(noon + late, schema), path, F.lit(as_of))
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == sorted(r[2] for r in noon + late)
    second = files()
    assert all(second[d] != f for d, f in first.items())
    changed = [(*r[:2], 7, *r[3:]) if r[2] == 1 else r for r in noon + late]
    sinks.apply_retention(spark.createDataFrame(changed, schema), path, F.lit(as_of))
    assert {d for d, f in files().items() if f != second.get(d)} == {"snap_date=2024-02-29"}
    assert [e[0] for e in sinks.read_manifest(spark, path).values()] == [2, 2, 2]
    os.rename(f"{path}/_manifest", f"{path}/_gone")
    sinks.apply_retention(spark.createDataFrame(changed, schema), path, F.lit(as_of))
    assert spark.read.parquet(path).count() == 6


def test_exposition_lines(spark):
    df = spark.createDataFrame([(1, T0, "b", "a", 3.0, 2.5)], "server_id long, snap_ts timestamp, y string, x string, n double, r double")
    rows = sinks.metric_rows(df, {"pg_up": F.col("n"), "other": F.col("r")}, {"y": F.col("y"), "x": F.col("x")})
    lines = {(r.metric, r.part): r.line for r in sinks.to_prometheus_lines(rows).collect()}
    assert lines[("pg_up", 2)] == 'pg_up{x="a",y="b"} 3'
    assert lines[("other", 2)] == 'other{x="a",y="b"} 2.500000'
    assert lines[("pg_up", 0)].startswith("# HELP pg_up ") and lines[("pg_up", 1)] == "# TYPE pg_up gauge"
    root = tempfile.mkdtemp(prefix="fleetstat-test-")
    sinks.write_lines(sinks.to_prometheus_lines(rows), f"{root}/prom")
    sinks.write_lines(sinks.to_prometheus_lines(rows), f"{root}/prom")
    assert spark.read.text(f"{root}/prom").count() == 6
    odd = sinks.metric_rows(df.withColumn("x", F.lit('a"b\\c\nd, e=f')), {"pg_up": F.col("n")}, {"x": F.col("x")})
    line = next(r.line for r in sinks.to_prometheus_lines(odd).collect() if r.part == 2)
    assert line == 'pg_up{x="a\\"b\\\\c\\nd, e=f"} 3'
    servers = df.select("server_id", "snap_ts", F.lit("h 1").alias("host"))
    assert ',x=a"b\\c\\nd\\,\\ e\\=f pg_up=3 ' in sinks.to_influx_lines(odd, servers).first().line


def test_plans_have_no_cartesian_product_and_prune_columns(spark):
    s = Snapshots.from_tables(spark, "/root/testdata/sf0.001")
    for id in ("QP2", "WE1", "RM4", "RM12", "CP1", "SC9", "MS7", "CA10", "MI2", "PM2"):
        plan = registry.run(id, s)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, id
        assert "SinglePartition" not in plan, id
    for id in ("QP2", "BL1", "TP6", "DG9"):  # top-k is cut inside every partition before the shuffle
        assert "WindowGroupLimit" in registry.run(id, s)._jdf.queryExecution().executedPlan().toString(), id
    plan = registry.run("WE1", s)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan


def test_index_bloat_around_its_threshold(spark):
    """An index of exactly the pages it needs has none; ten per cent is not yet an alert, a page more is."""
    from fleetstat.operators.alerts import evaluate_alerts
    from fleetstat.plans import checks, indexes, rules
    from fleetstat.sources.snapshots import Snapshots

    page, per_page = 8192, 7336 // (16 + 12)
    n_rows = 899 * per_page
    needed = 900 * page
    sizes = {"exact": needed, "small": page, "at": 1000 * page, "over": 1001 * page}
    index = [(1, T0, 5, "s", "t", name, [1, 2], size, f"CREATE INDEX {name} ON s.t (a, lower(b))") for name, size in sizes.items()]
    snaps = Snapshots.from_frames(
        spark,
        index_stats=spark.createDataFrame(index, "server_id long, snap_ts timestamp, relid long, schemaname string, table_name string, index_name string, indkey array<int>, index_size long, indexdef string"),
        table_stats=spark.createDataFrame([(1, T0, 5, n_rows)], "server_id long, snap_ts timestamp, relid long, n_live_tup long"),
        column_stats=spark.createDataFrame([(1, T0, 5, "a", 3)], "server_id long, snap_ts timestamp, relid long, attname string, avg_width long"))
    got = {r["index_name"]: r for r in indexes.index_sizes(snaps).collect()}
    assert {r["expected_bytes"] for r in got.values()} == {needed} and {r["key_width"] for r in got.values()} == {16}
    assert {n: float(r["bloat_percent"]) for n, r in got.items()} == {"exact": 0.0, "small": 0.0, "at": 10.0, "over": 10.09}
    whole = Snapshots.from_tables(spark, "/root/testdata/sf0.001")
    empty = {r: getattr(whole, r).limit(0) for r in ("locks", "activity", "settings", "servers", "repl_stats", "repl_slots", "database_stats")}
    snaps = Snapshots.from_frames(spark, **{**empty, "index_stats": snaps.index_stats, "table_stats": snaps.table_stats, "column_stats": snaps.column_stats})
    samples = checks.alert_samples(snaps, {"index_bloat_percent"})
    assert {r["object"] for r in evaluate_alerts(samples, rules.alert_rules(spark, "AL3")).collect()} == {"over"}
