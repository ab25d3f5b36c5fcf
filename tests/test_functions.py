"""Column arithmetic and ladders on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from fleetstat import functions as X
from fleetstat.functions import Ladder
from fleetstat.plans import connections, maintenance, resources, statements


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return tuple(row.select(*columns).first())


@pytest.mark.parametrize("dead, live, expected", [
    (450000, 1800000, 20.00), (890000, 120000, 88.12), (75000, 950000, 7.32), (0, 10, 0.0), (0, 0, None), (1, 7999, 0.01)])
def test_dead_percent(spark, dead, live, expected):
    assert one(spark, resources.dead_percent(), n_dead_tup=dead, n_live_tup=live) == (expected,)


def test_percent_rounds_halves_up_exactly(spark):
    # 57/20000 is 0.285 %, which a binary fraction would round down.
    assert one(spark, X.percent(F.lit(57), F.lit(20000)), X.ratio(F.lit(1), F.lit(8), digits=2)) == (0.29, 0.13)


def test_division_by_zero_is_null(spark):
    assert one(spark, X.percent(F.lit(1), F.lit(0)), X.whole_quotient(F.lit(7), F.lit(0)), X.whole_quotient(F.lit(7), F.lit(2))) == (None, None, 3)


@pytest.mark.parametrize("n, text", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10485247, "10239 kB"), (10 * 1024**2, "10 MB"), (10 * 1024**3, "10 GB"),
    (20 * 1024**4, "20 TB"), (20 * 1024**5, "20 PB"), (None, None)])
def test_pretty_bytes(spark, n, text):
    assert one(spark, X.pretty_bytes(F.lit(n).cast("bigint"))) == (text,)


@pytest.mark.parametrize("text, n", [
    ("10GB", 10 * 1024**3), ("512 MB", 512 * 1024**2), ("1G", 1024**3), ("4096", 4096), ("8kB", 8 * 1024), ("x", None), ("1.5GB", None)])
def test_parse_bytes(spark, text, n):
    assert one(spark, X.parse_bytes(F.lit(text))) == (n,)


def test_setting_bytes(spark):
    df = spark.createDataFrame([("128", "8kB"), ("on", None), ("5", None), ("2", "MB")], "setting string, unit string")
    assert [r[0] for r in df.select(X.setting_bytes()).collect()] == [1048576, None, 5, 2097152]


def test_log_positions(spark):
    assert one(spark, X.lsn_to_bytes(F.lit("16/B374D848")), X.lsn_diff(F.lit("1/0"), F.lit("0/FFFFFFFF"))) == (0x16B374D848, 1)
    # A position on a segment boundary still belongs to the segment before it.
    assert one(spark, X.wal_file_name(F.lit("0/2000000")), X.wal_file_name(F.lit("0/2000001"))) == (
        "000000010000000000000001", "000000010000000000000002")


def test_text_helpers(spark):
    assert one(spark, X.snippet(F.lit("ab"), 5), X.normalise_parameters(F.lit("x = $12 and y=$3"))) == ("ab...", "x = ? and y=?")
    assert one(spark, X.match_globs(F.lit("user_log"), "abc,user_*"), X.match_globs(F.lit("zzz"), "abc,user_*"), X.match_globs(F.lit("z"), None)) == (
        True, False, True)
    assert one(spark, X.matches_ci(F.lit("DROP x"), "(alter|drop)"), X.is_monitoring_query(F.lit("select pg_stat_x"))) == (True, True)


def test_underscore_is_a_wildcard(spark):
    assert one(spark, F.lit("pgxadmin").like("pg_%")) == (True,)


def test_age_is_total_not_a_field(spark):
    from fleetstat.plans.colstats import hours_since
    df = spark.sql("SELECT TIMESTAMP '2024-01-10 05:00:00' AS snap_ts, TIMESTAMP '2024-01-01 00:00:00' AS t, CAST(NULL AS TIMESTAMP) AS n")
    assert tuple(df.select(hours_since("t", "n"), X.age_seconds("t"), X.older_than("t", 795600), X.older_than("t", 795599)).first()) == (
        221, 795600, False, True)


def test_arrays_and_options(spark):
    df = spark.createDataFrame([(["fillfactor=70", "x=1"],), (["x=1"],), (None,), ([],)], "o array<string>")
    assert [tuple(r) for r in df.select(X.fillfactor_of("o"), X.array_length("o")).collect()] == [(70, 2), (100, 1), (100, None), (100, None)]


def test_ladder_order_null_and_default(spark):
    ladder = Ladder(("x > 10", "big"), ("x > 5", "mid"), default="small")
    df = spark.createDataFrame([(11,), (10,), (5,), (None,)], "x int")
    assert [tuple(r) for r in df.select(ladder.column(), ladder.rank()).collect()] == [("big", 1), ("mid", 2), ("small", 3), ("small", 3)]


@pytest.mark.parametrize("ladder, row, label", [
    (statements.PERFORMANCE_CATEGORY, dict(stddev_exec_time=201.0, mean_exec_time=100.0, total_blocks=0), "HIGH_VARIANCE"),
    (statements.PERFORMANCE_CATEGORY, dict(stddev_exec_time=200.0, mean_exec_time=100.0, total_blocks=0), "NORMAL"),
    (statements.PERFORMANCE_CATEGORY, dict(stddev_exec_time=0.0, mean_exec_time=5000.5, total_blocks=0), "VERY_SLOW"),
    (statements.PERFORMANCE_CATEGORY, dict(stddev_exec_time=0.0, mean_exec_time=5000.0, total_blocks=50001), "IO_BOUND"),
    (statements.PERFORMANCE_CATEGORY, dict(stddev_exec_time=0.0, mean_exec_time=1001.0, total_blocks=50000), "SLOW"),
    (statements.STATEMENT_TYPE, dict(query="insert into t"), "INSERT"),
    (statements.STATEMENT_TYPE, dict(query=" SELECT 1"), "OTHER"),
    (maintenance.VACUUM_PRIORITY, dict(n_dead_tup=51, n_live_tup=100), "URGENT"),
    (maintenance.VACUUM_PRIORITY, dict(n_dead_tup=50, n_live_tup=100), "HIGH"),
    (maintenance.VACUUM_PRIORITY, dict(n_dead_tup=20, n_live_tup=100), "MODERATE"),
    (maintenance.VACUUM_PRIORITY, dict(n_dead_tup=10, n_live_tup=100), "LOW"),
    (resources.CACHE_PERFORMANCE, dict(blks_hit=0, blks_read=0), "NO_ACTIVITY"),
    (resources.CACHE_PERFORMANCE, dict(blks_hit=95, blks_read=5), "GOOD"),
    (resources.CACHE_PERFORMANCE, dict(blks_hit=96, blks_read=4), "EXCELLENT"),
    (resources.CACHE_PERFORMANCE, dict(blks_hit=80, blks_read=20), "POOR"),
    (resources.BLOAT_BAND, dict(dead_tuple_percent=10.0), "healthy"),
    (resources.BLOAT_BAND, dict(dead_tuple_percent=60.01), "emergency"),
    (connections.UTILIZATION, dict(total_connections=80, max_connections=100), "WARNING: >60% connection limit used"),
    (connections.UTILIZATION, dict(total_connections=81, max_connections=100), "CRITICAL: >80% connection limit used"),
])
def test_thresholds(spark, ladder, row, label):
    assert one(spark, ladder.column(), **row) == (label,)
