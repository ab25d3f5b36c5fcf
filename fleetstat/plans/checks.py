"""Findings, alerts and readiness built from the other reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP, Ladder, age_seconds, as_number, percent, pretty_bytes, qualified, n_rows
from fleetstat.operators.alerts import evaluate_alerts, lasting_alerts
from fleetstat.operators.history import with_previous
from fleetstat.operators.joins import LOCK_OBJECT, blocked_sessions, pivot_settings, shuffled, snapshot_diff
from fleetstat.operators.ranking import top_k
from fleetstat.plans import admin, config, connections, indexes, partitions, resources, security, servers
from fleetstat.plans.registry import report
from fleetstat.plans.resources import dead_percent, session_counts
from fleetstat.plans.rules import ALERT_RULES, alert_rules
from fleetstat.sources import sinks
from fleetstat.sources.snapshots import Snapshots

TOKEN = "^(CRITICAL|ERROR|HIGH|WARNING|MEDIUM|NOTICE|INFO|LOW|OK|NORMAL|MISSING|POOR|EMERGENCY)"
# Severities of message tokens that are not severities themselves.
SEVERITY = Ladder.lookup("token", {
    "MISSING": "WARNING", "POOR": "WARNING", "EMERGENCY": "CRITICAL", "NORMAL": "OK", "": "INFO"}, None)


# Columns that name a locked object by their value alone; the others follow with their name, where they are set.
NAMED = ["locktype", "database", "relation", "transactionid"]


def _finding(df: DataFrame, check: str, object: Column, message: Column, value: Column) -> DataFrame:
    text = df.select(*SNAP, F.lit(check).alias("check_name"), object.cast("string").alias("object"), message.alias("message"),
                     value.cast("double").alias("value"))
    marked = text.withColumn("token", F.regexp_extract(F.upper("message"), TOKEN, 1))
    return marked.withColumn("severity", F.coalesce(SEVERITY.column(), "token")).drop("token")


def quick_findings(s: Snapshots) -> list[DataFrame]:
    col, none = F.col, F.lit(None)
    waiting = s.locks.groupBy(*SNAP).agg(F.count_if(~col("granted")).alias("n"))
    waits = F.when(col("n") > 0, F.format_string("WARNING: %d ungranted locks", "n")).otherwise("OK: no ungranted locks")
    return [
        _finding(connections.connection_utilization(s), "Connection Analysis", F.lit("connections"), col("utilization_status"),
                 col("connection_utilization_percent")),
        _finding(connections.problem_connections(s).where(col("connection_status") != "Normal"), "Connection Analysis", col("pid"),
                 col("connection_status"), col("state_age_seconds")),
        _finding(waiting, "Lock Analysis", F.lit("locks"), waits, col("n")),
        _finding(servers.slot_health(s), "Replication Status", col("slot_name"), col("slot_health"), col("lag_bytes")),
        _finding(servers.backup_complexity(s), "Transaction Wraparound", col("database_name"), col("wraparound_risk"), col("xid_age")),
        _finding(servers.backup_readiness(s), "Backup Validation", F.lit("server"), col("overall_status"), none),
        _finding(servers.archiver_health(s), "Backup Validation", F.lit("archiver"), col("failure_status"), col("total_failed")),
    ]


def full_findings(s: Snapshots) -> list[DataFrame]:
    col, none = F.col, F.lit(None)
    return [
        _finding(resources.bloat_bands(s), "Table Bloating", col("table_name"), F.upper("band"), col("dead_tuple_percent")),
        _finding(resources.database_io(s), "Buffer Performance", col("database_name"), col("cache_performance"), col("cache_hit_ratio")),
        _finding(indexes.unused_indexes(s).where(col("times_used") == 0), "Index Analysis", col("index_name"),
                 F.concat(F.lit("NOTICE: "), "usage_assessment"), col("index_size_bytes")),
        _finding(indexes.fillfactor_candidates(s), "HOT Updates", col("table_name"), F.lit("WARNING: Low HOT update percentage"),
                 col("hot_update_percent")),
        _finding(partitions.partition_balance(s), "Partition Management", col("parent_table"), col("partition_count_assessment"),
                 col("partition_count")),
        _finding(security.role_risk(s), "Security Audit", col("role_name"), col("security_risk_level"), none),
        _finding(security.function_risk(s), "Security Audit", col("function_name"), col("security_risk"), none),
        _finding(admin.risky_extensions(s), "Extensions Audit", col("extname"), F.lit("WARNING: extension reaches outside the database"), none),
        _finding(admin.unexpected_owners(s), "Table Ownership", qualified(), F.lit("NOTICE: unexpected owner"), none),
        _finding(indexes.fk_missing_index(s).where(col("index_status") == indexes.MISSING), "Foreign Constraints",
                 F.concat_ws(".", "table_name", "fk_column"), col("index_status"), col("estimated_rows")),
    ]


@report("CK1", order="server_id, check_name, object")
def health_findings(s: Snapshots, mode: str = "full") -> DataFrame:
    """Findings of the essential checks, or of all."""
    if mode not in ("quick", "full"):
        raise ValueError("mode is 'quick' or 'full'")
    parts = quick_findings(s) + (full_findings(s) if mode == "full" else [])
    return reduce(DataFrame.unionByName, parts)


@report("CK1Q", order="server_id, check_name, object")
def health_findings_quick(s: Snapshots) -> DataFrame:
    return health_findings(s, "quick")


@report("CK6", order="check_name, severity")
def severity_report(s: Snapshots, mode: str = "full") -> DataFrame:
    return health_findings(s, mode).groupBy(*SNAP, "check_name", "severity").agg(n_rows().alias("findings"))


@report("S7", order="server_id")
def report_json(s: Snapshots) -> DataFrame:
    """The report document of every server, read back to show its sections in order."""
    docs = sinks.to_report_json(health_findings(s, "quick"), s.servers)
    sections = F.from_json(F.get_json_object("body", "$.sections"), "array<struct<name:string,findings:bigint,content:string>>")
    shown = F.transform(sections, lambda x: F.concat_ws("|", x["name"], x["findings"].cast("string"), x["content"]))
    return docs.select(
        *SNAP, F.get_json_object("body", "$.report_metadata.database").alias("database"),
        F.get_json_object("body", "$.report_metadata.version").alias("version"), F.array_join(shown, ";").alias("sections_in_order"))


@report("S7L", order="server_id, check_name, severity, object")
def report_lines(s: Snapshots, mode: str = "full") -> DataFrame:
    """Every finding of the report as a JSON line of its section, read back: all messages, not only the worst one."""
    lines = sinks.to_section_lines(health_findings(s, mode))
    read = F.from_json("line", "name string, object string, severity string, message string, value double")
    return lines.select(*SNAP, read.alias("x")).select(
        *SNAP, F.col("x.name").alias("check_name"), "x.object", "x.severity", "x.message", "x.value")


# --- key figures ------------------------------------------------------------------

def _kv(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*SNAP, F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in values.items()])))


@report("CK2")
def incident_snapshot(s: Snapshots) -> DataFrame:
    state = F.col("state")
    counts = s.activity.groupBy(*SNAP).agg(
        n_rows().alias("total"), F.count_if(state == "active").alias("active"),
        F.count_if(state == "idle in transaction").alias("idle_tx"), F.count_if(F.col("wait_event").isNotNull()).alias("waiting"))
    return _kv(counts, {"Connection Count": F.col("total"), "Active Queries": F.col("active"),
                        "Idle in Transaction": F.col("idle_tx"), "Waiting Queries": F.col("waiting")})


@report("CK2L", order="duration_seconds desc")
def incident_long_queries(s: Snapshots, min_seconds: int = 300, k: int = 10) -> DataFrame:
    aged = s.activity.withColumn("duration_seconds", age_seconds("query_start")).where(F.col("duration_seconds") > min_seconds)
    return top_k(aged, k, F.col("duration_seconds").desc(), F.col("pid").asc()).select(*SNAP, "pid", "duration_seconds", "query")


@report("CK3")
def daily_metrics(s: Snapshots) -> DataFrame:
    hit, read = F.sum("blks_hit"), F.sum("blks_read")
    blocks = s.database_stats.groupBy(*SNAP).agg(percent(hit, hit + read).alias("ratio"), F.sum("size_bytes").alias("size"))
    active = s.activity.groupBy(*SNAP).agg(F.count_if(F.col("state") == "active").alias("active"))
    return _kv(blocks.join(active, SNAP, "full"), {
        "Buffer Hit Ratio": F.format_string("%.2f%%", "ratio"), "Active Connections": F.col("active"), "Database Size": pretty_bytes("size")})


@report("CK7")
def basic_counts(s: Snapshots) -> DataFrame:
    one = lambda df, name: df.groupBy(*SNAP).agg(n_rows().alias(name))
    size = s.database_stats.groupBy(*SNAP).agg(F.sum("size_bytes").alias("database_bytes"))
    wide = size
    for df, name in ((s.table_stats, "user_tables"), (s.index_stats, "user_indexes"), (s.repl_stats, "replicas"), (s.activity, "sessions")):
        wide = wide.join(one(df, name), SNAP, "full")
    return _kv(wide, {n: F.coalesce(F.col(n), F.lit(0)) for n in ("database_bytes", "user_tables", "user_indexes", "replicas", "sessions")})


# --- readiness ----------------------------------------------------------------------

def _status(passes: Column, warns: Column, known: Column) -> Column:
    return F.when(known, F.when(passes, "PASS").when(warns, "WARN").otherwise("FAIL")).otherwise("UNKNOWN")


@report("CK4", order="server_id, category")
def production_readiness(s: Snapshots) -> DataFrame:
    """Checklist per server; a check without data for a server is UNKNOWN.

    A server without standbys runs alone by choice, so that check passes as soon as any server reports standbys at that scrape;
    without replication data at all nothing is known.
    """
    hit, read = F.sum("blks_hit"), F.sum("blks_read")
    facts = (
        s.servers.select(*SNAP)
        .join(security.security_grade(s).select(*SNAP, F.col("overall_security_grade").alias("grade")), SNAP, "left")
        .join(servers.backup_readiness(s).select(*SNAP, F.col("overall_status").alias("backup")), SNAP, "left")
        .join(s.database_stats.groupBy(*SNAP).agg(percent(hit, hit + read).alias("ratio")), SNAP, "left")
        .join(config.configuration_advice(s).groupBy(*SNAP).agg(
            F.count_if(F.col("recommendation").startswith("CRITICAL")).alias("config_issues")), SNAP, "left")
        .join(s.relations.groupBy(*SNAP).agg(n_rows().alias("relation_count")), SNAP, "left")
        .join(admin.tables_without_primary_key(s).groupBy(*SNAP).agg(n_rows().alias("no_pk")), SNAP, "left")
        .join(s.extensions.groupBy(*SNAP).agg(F.count_if(F.col("extname") == "pg_stat_statements").alias("monitored")), SNAP, "left")
        .join(s.repl_stats.groupBy("snap_ts").agg(n_rows().alias("standbys")), "snap_ts", "left")
        .join(pivot_settings(s.settings, "autovacuum"), SNAP, "left")
        .join(connections.connection_utilization(s).select(*SNAP, F.col("connection_utilization_percent").alias("used")), SNAP, "left"))
    yes, no = F.lit(True), F.lit(False)
    checks = {
        "SECURITY": _status(F.col("grade").startswith("GOOD"), ~F.col("grade").startswith("CRITICAL"), F.col("grade").isNotNull()),
        "BACKUP": _status(F.col("backup").startswith("OK"), F.col("backup").startswith("WARNING"), F.col("backup").isNotNull()),
        "PERFORMANCE": _status(F.col("ratio") > 95, F.col("ratio") > 90, F.col("ratio").isNotNull()),
        "CONFIGURATION": _status(F.col("config_issues") == 0, yes, F.col("config_issues").isNotNull()),
        "SCHEMA": _status(F.coalesce("no_pk", F.lit(0)) == 0, yes, F.col("relation_count").isNotNull()),
        "MONITORING": _status(F.col("monitored") > 0, yes, F.col("monitored").isNotNull()),
        "REPLICATION": _status(yes, yes, F.col("standbys").isNotNull()),
        "MAINTENANCE": _status(F.col("autovacuum") == "on", no, F.col("autovacuum").isNotNull()),
        "CAPACITY": _status(F.col("used") < 70, F.col("used") < 85, F.col("used").isNotNull()),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("category"), v.alias("status")) for k, v in checks.items()])
    return facts.select(*SNAP, F.inline(rows))


@report("A15", order="server_id")
def readiness_score(s: Snapshots) -> DataFrame:
    """Ready only if every check is known and none fails."""
    status = F.col("status")
    return production_readiness(s).groupBy(*SNAP).agg(
        F.count_if(status == "PASS").alias("passed"), F.count_if(status == "WARN").alias("warnings"),
        F.count_if(status == "FAIL").alias("failures"), F.count_if(status == "UNKNOWN").alias("unknown")).withColumn(
        "overall", F.when(F.col("failures") > 0, "NOT READY - CRITICAL ISSUES MUST BE RESOLVED")
        .when(F.col("unknown") > 0, "NOT READY - CHECKS WITHOUT DATA").otherwise("READY FOR PRODUCTION"))


@report("CK5", order="queryid")
def before_after(s: Snapshots, cut: str = "1999-01-01") -> DataFrame:
    """Statement totals before and after a maintenance date."""
    when = F.col("snap_ts") < F.lit(cut).cast("timestamp")
    sums = lambda df: df.groupBy("server_id", "queryid").agg(
        F.sum("calls").alias("calls"), F.sum("total_exec_time").alias("total_exec_time"))
    history = s.statement_history
    return snapshot_diff(sums(history.where(when)), sums(history.where(~when)), ["server_id", "queryid"], ["calls", "total_exec_time"])


# --- alerts ----------------------------------------------------------------------------

def alert_samples(s: Snapshots, metrics: set[str] | None = None) -> DataFrame:
    """(metric, object, value) samples that the documented rules are about; only those named, if any are."""
    col = F.col

    def sample(df: DataFrame, metric: str, object: Column, value: Column) -> DataFrame:
        return df.select(*SNAP, F.lit(metric).alias("metric"), object.cast("string").alias("object"), value.cast("double").alias("value"))

    def several(df: DataFrame, object: Column, **values: Column) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), object.cast("string").alias("object"), v.cast("double").alias("value"))
                         for m, v in values.items()])
        return df.select(*SNAP, F.inline(rows)).where("value IS NOT NULL")

    blocked = blocked_sessions(s.locks, s.activity).select(*SNAP, "pid", age_seconds("query_start").alias("age")).distinct()
    hit, read = F.sum("blks_hit"), F.sum("blks_read")
    counts = session_counts(s.activity).join(
        shuffled(pivot_settings(s.settings, "max_connections").select(*SNAP, as_number("max_connections").alias("limit"))), SNAP, "left")
    now = s.servers.select(*SNAP, "current_lsn")
    standbys = s.repl_stats.join(now, SNAP).withColumn("bytes", servers.lsn_diff("current_lsn", "replay_lsn"))
    lag, sync = col("replay_lag_s"), col("sync_state")
    locks = s.locks.groupBy(*SNAP).agg(F.count_if(~col("granted")).alias("waiting"))
    exclusive = s.locks.where(col("mode") == "AccessExclusiveLock").join(
        s.activity.where(F.hour("query_start").between(9, 16)).select(*SNAP, "pid"), [*SNAP, "pid"])
    idle_holders = s.locks.where("granted").join(
        s.activity.where(col("state").like("idle in transaction%")).select(*SNAP, "pid"), [*SNAP, "pid"])
    queues = s.locks.where(~col("granted")).groupBy(*SNAP, *LOCK_OBJECT).agg(n_rows().alias("waiters"))
    replicas = s.servers.select(*SNAP).join(s.repl_stats.groupBy(*SNAP).agg(n_rows().alias("n")), SNAP, "left")
    parts = [
        ({"blocked_seconds"}, lambda: sample(blocked, "blocked_seconds", col("pid"), col("age"))),
        ({"xid_percent", "xid_age"}, lambda: several(
            s.database_stats, col("datname"), xid_percent=percent("xid_age", F.lit(2_000_000_000)), xid_age=col("xid_age"))),
        ({"cache_hit_percent"}, lambda: sample(
            s.database_stats.groupBy(*SNAP).agg(percent(hit, hit + read).alias("v")), "cache_hit_percent", F.lit("server"), col("v"))),
        ({"bloat_percent"}, lambda: sample(s.table_stats, "bloat_percent", qualified(), dead_percent())),
        ({"index_bloat_percent"}, lambda: sample(indexes.index_sizes(s), "index_bloat_percent", col("index_name"), col("bloat_percent"))),
        ({"connection_percent", "idle_in_transaction_percent", "pool_efficiency_percent"}, lambda: several(
            counts, F.lit("server"), connection_percent=percent("total", "limit"),
            idle_in_transaction_percent=percent("idle_tx", "total"), pool_efficiency_percent=percent("active", "total"))),
        ({"sync_replication_lag_seconds", "async_replication_lag_seconds", "replication_lag_seconds", "replication_lag_bytes",
          "standby_catchup"}, lambda: several(
            standbys, col("application_name"), sync_replication_lag_seconds=F.when(sync == "sync", lag),
            async_replication_lag_seconds=F.when(sync == "async", lag), replication_lag_seconds=lag,
            replication_lag_bytes=col("bytes"), standby_catchup=F.when(col("state") == "catchup", F.lit(1)).otherwise(F.lit(0)))),
        ({"max_replication_lag_seconds"}, lambda: sample(
            s.repl_stats.groupBy(*SNAP).agg(F.max("replay_lag_s").alias("v")), "max_replication_lag_seconds", F.lit("server"), col("v"))),
        ({"inactive_slot_lag_bytes"}, lambda: sample(
            servers.slots_with_lag(s).where(~col("active")), "inactive_slot_lag_bytes", col("slot_name"), col("lag_bytes"))),
        ({"active_replicas"}, lambda: sample(replicas, "active_replicas", F.lit("server"), F.coalesce("n", F.lit(0)))),
        ({"ungranted_locks"}, lambda: sample(locks, "ungranted_locks", F.lit("server"), col("waiting"))),
        ({"access_exclusive_locks_in_business_hours"}, lambda: sample(
            exclusive.groupBy(*SNAP).agg(n_rows().alias("n")), "access_exclusive_locks_in_business_hours", F.lit("server"), col("n"))),
        ({"locks_held_idle_in_transaction"}, lambda: sample(
            idle_holders.groupBy(*SNAP).agg(n_rows().alias("n")), "locks_held_idle_in_transaction", F.lit("server"), col("n"))),
        ({"waiters_on_object"}, lambda: sample(
            queues, "waiters_on_object", F.concat_ws("/", *[col(k).cast("string") for k in NAMED], *[
                F.concat(F.lit(f"{k}="), col(k).cast("string")) for k in LOCK_OBJECT if k not in NAMED]), col("waiters"))),
    ]
    chosen = [build() for names, build in parts if metrics is None or names & metrics]
    return reduce(DataFrame.unionByName, chosen).where("value IS NOT NULL")


def _alerts(s: Snapshots, rule_set: str) -> DataFrame:
    """What fires at a scrape: rules without a duration at once, others after the breach has lasted through the scrapes before."""
    wanted = {r[1] for r in ALERT_RULES if r[0] == rule_set}
    samples, rules, columns = alert_samples(s, wanted), alert_rules(s.spark, rule_set), [*SNAP, "metric", "object", "value", "severity"]
    fired = evaluate_alerts(samples, rules.where("for_seconds = 0")).select(*columns)
    if any(r[0] == rule_set and r[6] for r in ALERT_RULES):
        fired = fired.unionByName(lasting_alerts(samples, rules.where("for_seconds > 0")).select(*columns))
    return fired


@report("AL1")
def critical_alerts(s: Snapshots) -> DataFrame:
    return _alerts(s, "AL1")


@report("AL2")
def warning_alerts(s: Snapshots) -> DataFrame:
    return _alerts(s, "AL2")


@report("AL3")
def monitor_alerts(s: Snapshots) -> DataFrame:
    return _alerts(s, "AL3")


@report("AL4")
def replication_alerts(s: Snapshots) -> DataFrame:
    """What fires at each scrape; a catchup of more than half an hour needs scrapes of half an hour."""
    return _alerts(s, "AL4")


def replication_samples(s: Snapshots) -> DataFrame:
    """Lag and catchup of every standby at every scrape of its history."""
    values = F.array(
        F.struct(F.lit("replication_lag_seconds").alias("metric"), F.col("replay_lag_s").cast("double").alias("value")),
        F.struct(F.lit("standby_catchup").alias("metric"), F.when(F.col("state") == "catchup", 1.0).otherwise(0.0).alias("value")))
    return s.repl_history.select(*SNAP, F.col("application_name").alias("object"), F.inline(values)).where("value IS NOT NULL")


@report("AL4T", order="server_id, metric, object, since")
def lasting_replication_alerts(s: Snapshots, gap: str = "2 hours") -> DataFrame:
    """Alerts that must last, one row for each run of scrapes at which they fired."""
    fired = lasting_alerts(replication_samples(s), alert_rules(s.spark, "AL4").where("for_seconds > 0"), gap)
    runs = fired.groupBy("server_id", "metric", "object", "severity", "since").agg(
        F.min("snap_ts").alias("first_fired"), F.max("snap_ts").alias("last_fired"), n_rows().alias("scrapes"), F.max("value").alias("worst_value"))
    return runs.select(
        "server_id", "metric", "object", "severity", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("since", "first_fired", "last_fired")],
        "scrapes", "worst_value")


@report("AL4G", order="server_id, object, day")
def growing_replication_lag(s: Snapshots, least_samples: int = 3, least_slope: float = 0.0001) -> DataFrame:
    """Days on which a standby's lag grew: seconds of lag gained per second, by least squares."""
    at = F.unix_micros("snap_ts") / 1_000_000 - F.unix_micros(F.date_trunc("day", "snap_ts")) / 1_000_000
    days = s.repl_history.where("replay_lag_s IS NOT NULL").groupBy("server_id", F.col("application_name").alias("object"), F.date_trunc("day", "snap_ts").alias("day")).agg(
        F.regr_slope(F.col("replay_lag_s").cast("double"), at).alias("slope"), n_rows().alias("samples"),
        F.max_by("replay_lag_s", F.struct("snap_ts", "sample_id")).alias("latest_lag_s"))
    grew = days.where((F.col("samples") >= least_samples) & (F.col("slope") > least_slope))
    return grew.select(
        "server_id", "object", F.date_format("day", "yyyy-MM-dd").alias("day"), "samples", "latest_lag_s", F.round("slope", 9).alias("slope"),
        F.lit("MONITOR").alias("severity"))


@report("AL4S", order="server_id, object, day")
def frequent_sync_changes(s: Snapshots, least: int = 3) -> DataFrame:
    """Days on which a standby changed between synchronous and asynchronous at least so often."""
    paired = with_previous(s.repl_history, ["server_id", "application_name"], ["snap_ts", "sample_id"], ["sync_state"]).where("prev IS NOT NULL")
    changed = ~F.col("sync_state").eqNullSafe(F.col("prev.sync_state"))
    days = paired.groupBy("server_id", F.col("application_name").alias("object"), F.date_format("snap_ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(changed).alias("changes"))
    return days.where(F.col("changes") >= least).withColumn("severity", F.lit("MONITOR"))


@report("AL5")
def lock_alerts(s: Snapshots) -> DataFrame:
    return _alerts(s, "AL5")


@report("AL6")
def configured_alerts(s: Snapshots) -> DataFrame:
    return _alerts(s, "AL6")


@report("AL7")
def scheduled_alerts(s: Snapshots) -> DataFrame:
    return _alerts(s, "AL7")
