from fleetstat.plans.rules import ALERT_RULES
from oracles.sqltext import clock, pct, r2


def lagged(source: str, keys: str, order: str, *values: str) -> str:
    cols = ", ".join(f"lag({v}) OVER w AS prev_{v}" for v in ("snap_ts", *values))
    return f"(SELECT *, {cols} FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) d"


def grown(v: str) -> str:
    return f"CASE WHEN prev_{v} IS NULL THEN NULL WHEN {v} < prev_{v} THEN {v} ELSE {v} - prev_{v} END"


COUNTERS = lagged("counters", "server_id, metric_key", "snap_ts, sample_id", "value", "sync_state")
IO = lagged("io_history", "server_id, datname", "snap_ts, sample_id", "blks_hit", "blks_read")
TRANSACTIONS = lagged("transaction_history", "server_id, datname", "snap_ts, sample_id", "xact_commit", "xact_rollback")
CHECKPOINTS = lagged("checkpoint_history", "server_id", "snap_ts, sample_id", "checkpoints_timed", "checkpoints_req", "buffers_checkpoint")
SECONDS = "(epoch_us({0}) - epoch_us({1})) / 1000000.0"
BREACHES = "(" + " UNION ALL ".join(
    f"SELECT server_id, snap_ts, metric, object, value, '{sev}' AS severity, {secs}::BIGINT AS for_seconds FROM samples WHERE metric = '{metric}'"
    + (f" AND value > {low}" if low is not None else "") + (f" AND value < {high}" if high is not None else "")
    for name, metric, low, high, _, sev, secs in ALERT_RULES if name == "TREND") + ") b"


def sessions(source: str, keys: str, gap: int, extra: str, outer: str) -> str:
    """Gaps-and-islands: a new session starts when the gap to the previous row reaches the limit."""
    return f"""SELECT {keys}, {outer} FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY snap_ts ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN epoch_us(snap_ts) - lag(epoch_us(snap_ts)) OVER (PARTITION BY {keys} ORDER BY snap_ts) <= {gap}::BIGINT * 1000000 THEN 0 ELSE 1 END AS fresh
              FROM {source}) f) g GROUP BY {keys}, island {extra}"""


SQL = {
    "w3_counter_delta": f"""SELECT server_id, metric_key, sample_id, value, {grown('value')} AS value_delta,
        {r2(SECONDS.format('snap_ts', 'prev_snap_ts'), 3)} AS seconds FROM {COUNTERS}""",
    "st2_counter_rate": f"""SELECT {clock('ws')} AS window_start, {clock("ws + INTERVAL 2 HOUR")} AS window_end, server_id, metric_key,
        increase, {r2('secs', 3)} AS seconds, {r2('increase / nullif(secs, 0)', 6)} AS rate FROM (
        SELECT ws, server_id, metric_key, sum({grown('value')})::BIGINT AS increase, {SECONDS.format('max(snap_ts)', 'min(prev_snap_ts)')} AS secs
        FROM (SELECT d.*, time_bucket(INTERVAL 30 MINUTE, snap_ts) - to_minutes(30 * k::BIGINT) AS ws FROM {COUNTERS}, unnest([0, 1, 2, 3]) AS t(k)) e
        WHERE prev_snap_ts >= ws GROUP BY ws, server_id, metric_key) f""",
    "st1_activity_over_time": f"""SELECT {clock('h')} AS window_start, {clock('h + INTERVAL 1 HOUR')} AS window_end, server_id, count(*) AS total,
        count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'idle') AS idle,
        count(*) FILTER (query LIKE 'autovacuum:%') AS autovacuum_processes
        FROM (SELECT *, date_trunc('hour', snap_ts) AS h FROM activity_history) x GROUP BY h, server_id""",
    "st3_hit_ratio_over_time": f"""SELECT {clock('day')} AS window_start, {clock('day + INTERVAL 1 DAY')} AS window_end, server_id, datname,
        sum({grown('blks_hit')})::BIGINT AS hit, sum({grown('blks_read')})::BIGINT AS read,
        {pct(f"sum({grown('blks_hit')})", f"(sum({grown('blks_hit')}) + sum({grown('blks_read')}))")} AS hit_percent
        FROM (SELECT *, date_trunc('day', snap_ts) AS day FROM {IO}) x WHERE prev_snap_ts IS NOT NULL GROUP BY day, server_id, datname""",
    "dg6_transaction_rate": f"""SELECT {clock('day')} AS window_start, {clock('day + INTERVAL 1 DAY')} AS window_end, server_id, datname, commits, rollbacks,
        {r2('secs', 3)} AS seconds, {r2('commits / nullif(secs, 0)', 6)} AS commits_per_second, {r2('rollbacks / nullif(secs, 0)', 6)} AS rollbacks_per_second,
        {pct('rollbacks', '(commits + rollbacks)')} AS rollback_percent FROM (
        SELECT date_trunc('day', snap_ts) AS day, server_id, datname, sum({grown('xact_commit')})::BIGINT AS commits,
          sum({grown('xact_rollback')})::BIGINT AS rollbacks, sum(epoch_us(snap_ts) - epoch_us(prev_snap_ts)) / 1000000.0 AS secs
        FROM {TRANSACTIONS} WHERE prev_snap_ts IS NOT NULL GROUP BY ALL) x""",
    "dg11_checkpoint_activity": f"""SELECT {clock('day')} AS window_start, {clock('day + INTERVAL 1 DAY')} AS window_end, server_id, checkpoints_timed,
        checkpoints_req, buffers_checkpoint, {r2('secs', 3)} AS seconds, {pct('checkpoints_req', '(checkpoints_timed + checkpoints_req)')} AS requested_percent,
        {r2('buffers_checkpoint / nullif(secs, 0)', 6)} AS buffers_per_second FROM (
        SELECT date_trunc('day', snap_ts) AS day, server_id, sum({grown('d.checkpoints_timed').replace('prev_d.', 'prev_')})::BIGINT AS checkpoints_timed,
          sum({grown('d.checkpoints_req').replace('prev_d.', 'prev_')})::BIGINT AS checkpoints_req,
          sum({grown('d.buffers_checkpoint').replace('prev_d.', 'prev_')})::BIGINT AS buffers_checkpoint,
          sum(epoch_us(snap_ts) - epoch_us(prev_snap_ts)) / 1000000.0 AS secs
        FROM {CHECKPOINTS} WHERE prev_snap_ts IS NOT NULL GROUP BY ALL) x""",
    "st4_evaluate_trend_alerts": f"SELECT server_id, {clock('snap_ts')} AS seen_at, metric, object, value, severity FROM {BREACHES}",
    "st5_sustained_alerts": "SELECT * FROM (" + sessions(
        BREACHES, "server_id, metric, object, severity, for_seconds", 43200,
        f"HAVING {SECONDS.format('max(snap_ts)', 'min(snap_ts)')} >= for_seconds",
        f"""{clock('min(snap_ts)')} AS first_breach, {clock('max(snap_ts)')} AS last_breach,
            {r2(SECONDS.format('max(snap_ts)', 'min(snap_ts)'), 3)} AS lasted_seconds, count(*) AS samples, max(value) AS worst_value""") + ") z",
    "st6_blocking_episodes": sessions(
        "pair_history", "server_id, blocked_pid, blocking_pid", 86400, "",
        f"""{clock('min(snap_ts)')} AS first_seen, {clock('max(snap_ts)')} AS last_seen, count(*) AS scrapes,
            {r2(SECONDS.format('max(snap_ts)', 'min(snap_ts)'), 3)} AS lasted_seconds"""),
    "st7_state_changes": f"""SELECT {clock('day')} AS window_start, {clock('day + INTERVAL 1 DAY')} AS window_end, server_id, metric_key,
        count(*) FILTER (sync_state IS DISTINCT FROM prev_sync_state) AS changes
        FROM (SELECT *, date_trunc('day', snap_ts) AS day FROM {COUNTERS}) x WHERE prev_snap_ts IS NOT NULL GROUP BY day, server_id, metric_key""",
    "st8_distinct_scrapes": """SELECT server_id, metric_key, count(*) AS scrapes FROM (SELECT DISTINCT server_id, metric_key,
        date_trunc('minute', snap_ts) AS m FROM counters) x GROUP BY server_id, metric_key""",
    "w4_degradation": f"""SELECT server_id, queryid, {clock('period')} AS period, n AS period_count, {r2('t / n', 3)} AS mean,
        {r2('bt / nullif(bn, 0)', 3)} AS baseline_mean, {r2('(t / n) / nullif(bt / nullif(bn, 0), 0)', 4)} AS ratio FROM (
        SELECT *, sum(t) OVER w AS bt, sum(n) OVER w AS bn FROM (SELECT server_id, queryid, date_trunc('month', snap_ts) AS period,
          sum(calls)::BIGINT AS n, sum(total_exec_time) AS t FROM statement_history GROUP BY ALL) p
        WINDOW w AS (PARTITION BY server_id, queryid ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) x""",
    "j13_snapshot_change": """WITH b AS (SELECT server_id, datname, arg_max(size_bytes, (snap_ts, size_bytes)) AS v FROM size_history WHERE snap_ts < TIMESTAMP '1998-01-01' GROUP BY ALL),
        a AS (SELECT server_id, datname, arg_max(size_bytes, (snap_ts, size_bytes)) AS v FROM size_history WHERE snap_ts < TIMESTAMP '2001-01-01' GROUP BY ALL)
        SELECT coalesce(a.server_id, b.server_id) AS server_id, coalesce(a.datname, b.datname) AS datname, b.v AS size_bytes_before, a.v AS size_bytes_after,
               a.v - b.v AS size_bytes_change FROM b FULL JOIN a ON a.server_id = b.server_id AND a.datname = b.datname""",
    "a17_growth_trend": f"""SELECT server_id, datname, samples, latest_bytes, {r2('slope', 3)} AS bytes_per_day,
        CASE WHEN slope > 0 THEN {r2('(100000000 - latest_bytes) / slope', 1)} END AS days_to_limit FROM (SELECT server_id, datname, count(*) AS samples,
        regr_slope(size_bytes::DOUBLE, epoch(snap_ts) / 86400) AS slope, arg_max(size_bytes, (snap_ts, size_bytes)) AS latest_bytes
        FROM size_history GROUP BY server_id, datname) x""",
}
