"""Reports over many snapshots: the stored twins of the streaming jobs, deltas and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import percent
from fleetstat.operators import history
from fleetstat.operators.alerts import evaluate_alerts
from fleetstat.plans.registry import report
from fleetstat.plans.rules import alert_rules
from fleetstat.sources.snapshots import Snapshots
from fleetstat.streaming import windows

DISK_LIMIT = 100_000_000


def _times(df: DataFrame, *names: str) -> DataFrame:
    """Times as text with seconds."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in names else F.col(c) for c in df.columns])


BOUNDS = ("window_start", "window_end")


@report("W3", order="server_id, metric_key, sample_id")
def counter_delta(s: Snapshots) -> DataFrame:
    deltas = history.counter_delta(s.counters, ["server_id", "metric_key"], ["value"], tie="sample_id")
    return deltas.select("server_id", "metric_key", "sample_id", "value", "value_delta", F.round("seconds", 3).alias("seconds"))


@report("ST2", order="server_id, metric_key, window_start")
def counter_rate(s: Snapshots, window: str = "2 hours", slide: str = "30 minutes") -> DataFrame:
    """Rate in sliding windows from consecutive samples that both lie in the window. Nothing is gathered:
    each delta is added to the windows that hold it and its predecessor."""
    keys = ["server_id", "metric_key"]
    deltas = history.counter_delta(s.counters, keys, ["value"], tie="sample_id").where("prev_ts IS NOT NULL")
    placed = deltas.withColumn("w", F.window("snap_ts", window, slide)).where(F.col("prev_ts") >= F.col("w.start"))
    summed = placed.groupBy("w", *keys).agg(
        F.sum("value_delta").alias("increase"), F.min("prev_ts").alias("first"), F.max("snap_ts").alias("last"))
    seconds = (F.unix_micros("last") - F.unix_micros("first")) / 1_000_000
    return _times(summed.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "increase",
        F.round(seconds, 3).alias("seconds"), F.round(F.try_divide(F.col("increase").cast("double"), seconds), 6).alias("rate")), *BOUNDS)


@report("ST1", order="server_id, window_start")
def activity_over_time(s: Snapshots, window: str = "1 hour") -> DataFrame:
    return _times(windows.activity_over_time(s.activity_history, window), *BOUNDS)


@report("ST3", order="server_id, datname, window_start")
def hit_ratio_over_time(s: Snapshots, window: str = "1 day") -> DataFrame:
    """Each step between two samples counts in the window of the later one, so windows add up to the whole growth."""
    keys = ["server_id", "datname"]
    deltas = history.counter_delta(s.io_history, keys, ["blks_hit", "blks_read"], tie="sample_id").where("prev_ts IS NOT NULL")
    placed = deltas.withColumn("w", F.window("snap_ts", window))
    hit, read = F.sum("blks_hit_delta"), F.sum("blks_read_delta")
    return _times(placed.groupBy("w", *keys).agg(hit.alias("hit"), read.alias("read"), percent(hit, hit + read).alias("hit_percent")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "hit", "read", "hit_percent"), *BOUNDS)


def _grown(df: DataFrame, keys: list[str], counters: list[str], window: str) -> DataFrame:
    """Growth of each counter and the seconds it took, per key and window.

    A step between two samples counts in the window of the later one, as in ST3; a reset starts from zero.
    Windows hold sums only, so neither the samples of a key nor those of a window meet in one task.
    """
    deltas = history.counter_delta(df, keys, counters, tie="sample_id").where("prev_ts IS NOT NULL")
    placed = deltas.withColumn("w", F.window("snap_ts", window))
    micros = F.sum(F.unix_micros("snap_ts") - F.unix_micros("prev_ts"))
    return placed.groupBy("w", *keys).agg(
        *[F.sum(f"{c}_delta").alias(c) for c in counters], (micros / 1_000_000).alias("seconds")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *counters, "seconds")


def _per_second(column: str) -> Column:
    return F.round(F.try_divide(F.col(column).cast("double"), "seconds"), 6)


@report("DG6", order="server_id, datname, window_start")
def transaction_rate(s: Snapshots, window: str = "1 day") -> DataFrame:
    """Commits and rollbacks of every database over time, a second and as a share of all transactions."""
    grown = _grown(s.transaction_history, ["server_id", "datname"], ["xact_commit", "xact_rollback"], window)
    return _times(grown.select(
        "window_start", "window_end", "server_id", "datname", F.col("xact_commit").alias("commits"), F.col("xact_rollback").alias("rollbacks"),
        F.round("seconds", 3).alias("seconds"), _per_second("xact_commit").alias("commits_per_second"),
        _per_second("xact_rollback").alias("rollbacks_per_second"),
        percent("xact_rollback", F.col("xact_commit") + F.col("xact_rollback")).alias("rollback_percent")), *BOUNDS)


@report("DG11", order="server_id, window_start")
def checkpoint_activity(s: Snapshots, window: str = "1 day") -> DataFrame:
    """Timed and requested checkpoints of every server over time, the share of requested ones and the buffers written."""
    counters = ["checkpoints_timed", "checkpoints_req", "buffers_checkpoint"]
    grown = _grown(s.checkpoint_history, ["server_id"], counters, window)
    both = F.col("checkpoints_timed") + F.col("checkpoints_req")
    return _times(grown.select(
        "window_start", "window_end", "server_id", *counters, F.round("seconds", 3).alias("seconds"),
        percent("checkpoints_req", both).alias("requested_percent"), _per_second("buffers_checkpoint").alias("buffers_per_second")), *BOUNDS)


def _breaches(s: Snapshots) -> DataFrame:
    return evaluate_alerts(s.samples, alert_rules(s.spark, "TREND"))


@report("ST4")
def evaluate_trend_alerts(s: Snapshots) -> DataFrame:
    return _times(_breaches(s).select("server_id", F.col("snap_ts").alias("seen_at"), "metric", "object", "value", "severity"), "seen_at")


@report("ST5", order="server_id, metric, object, first_breach")
def sustained_alerts(s: Snapshots, gap: str = "12 hours") -> DataFrame:
    lasting = windows.sustained_alerts(_breaches(s), gap)
    return _times(lasting.withColumn("lasted_seconds", F.round("lasted_seconds", 3)), "first_breach", "last_breach")


@report("ST6", order="server_id, blocked_pid, blocking_pid, first_seen")
def blocking_episodes(s: Snapshots, gap: str = "1 day") -> DataFrame:
    episodes = windows.blocking_episodes(s.pair_history, gap)
    return _times(episodes.withColumn("lasted_seconds", F.round("lasted_seconds", 3)), "first_seen", "last_seen")


@report("ST7", order="server_id, metric_key, window_start")
def state_changes(s: Snapshots, window: str = "1 day") -> DataFrame:
    """Adjacent differences of a state, in the window of the later sample."""
    keys = ["server_id", "metric_key"]
    paired = history.with_previous(s.counters, keys, ["snap_ts", "sample_id"], ["sync_state"]).where("prev IS NOT NULL")
    placed = paired.withColumn("w", F.window("snap_ts", window))
    changed = ~F.col("sync_state").eqNullSafe(F.col("prev.sync_state"))
    return _times(placed.groupBy("w", *keys).agg(F.count_if(changed).alias("changes")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "changes"), *BOUNDS)


@report("ST8")
def distinct_scrapes(s: Snapshots) -> DataFrame:
    """Samples left after dropping repeats of the same server, minute and key."""
    minute = s.counters.withColumn("scrape", F.date_trunc("minute", "snap_ts"))
    kept = windows.deduplicated(minute.select("server_id", "scrape", "metric_key"), ["server_id", "scrape", "metric_key"])
    return kept.groupBy("server_id", "metric_key").agg(F.count(F.lit(1)).alias("scrapes"))


@report("W4", order="server_id, queryid, period")
def degradation(s: Snapshots, period: str = "month", baseline: int = 3) -> DataFrame:
    trend = history.degradation(s.statement_history, ["server_id", "queryid"], "total_exec_time", "calls", period=period, baseline=baseline)
    return _times(trend.select(
        "server_id", "queryid", "period", "period_count", F.round("mean", 3).alias("mean"),
        F.round("baseline_mean", 3).alias("baseline_mean"), F.round("ratio", 4).alias("ratio")), "period")


@report("J13", order="server_id, datname")
def snapshot_change(s: Snapshots, before: str = "1998-01-01", after: str = "2001-01-01") -> DataFrame:
    """Newest size of every database up to two dates, side by side."""
    from fleetstat.operators.joins import snapshot_diff

    def newest(until: str) -> DataFrame:
        upto = s.size_history.where(F.col("snap_ts") < F.lit(until).cast("timestamp"))
        return upto.groupBy("server_id", "datname").agg(F.max_by("size_bytes", F.struct("snap_ts", "size_bytes")).alias("size_bytes"))

    return snapshot_diff(newest(before), newest(after), ["server_id", "datname"], ["size_bytes"])


@report("A17", order="bytes_per_day desc")
def growth_trend(s: Snapshots, limit: int = DISK_LIMIT) -> DataFrame:
    trend = history.growth_trend(s.size_history, ["server_id", "datname"], "size_bytes", limit=F.lit(limit))
    return trend.select("server_id", "datname", "samples", "latest_bytes", F.round("bytes_per_day", 3).alias("bytes_per_day"),
                        F.round("days_to_limit", 1).alias("days_to_limit"))
