"""Time-window reports that run on stored and on streaming snapshots.

Every function takes a frame and builds the same plan for both; a watermark only
matters to a stream. Results of a stream appear once their window has closed, and
rates, ratios and changes are of the samples inside a window. What must also count
the step from one window into the next is in ``stateful``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import percent, n_rows

LATENESS = "2 minutes"


def _late(df: DataFrame, lateness: str) -> DataFrame:
    """Set the watermark of a stream that has none yet; it may be set only once."""
    if not df.isStreaming or "spark.watermarkDelayMs" in df.schema["snap_ts"].metadata:
        return df
    return df.withWatermark("snap_ts", lateness)


def _bounds(window: str = "window") -> list[Column]:
    return [F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end")]


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Drop repeated scrapes of the same object; state is kept for the lateness only."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return _late(stream, lateness).dropDuplicatesWithinWatermark(keys)


def activity_over_time(df: DataFrame, window: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Sessions, active, idle and autovacuum sessions per server and window."""
    state = F.col("state")
    return _late(df, lateness).groupBy(F.window("snap_ts", window), "server_id").agg(
        n_rows().alias("total"), F.count_if(state == "active").alias("active"), F.count_if(state == "idle").alias("idle"),
        F.count_if(F.col("query").like("autovacuum:%")).alias("autovacuum_processes"),
    ).select(*_bounds(), "server_id", "total", "active", "idle", "autovacuum_processes")


def _in_order(samples: Column, field: str) -> Column:
    """Reset-aware growth along a time-ordered array of samples."""
    steps = F.sequence(F.lit(2), F.size(samples))
    def add(total: Column, i: Column) -> Column:
        now, before = F.element_at(samples, i)[field], F.element_at(samples, i - 1)[field]
        return total + F.when(now < before, now).otherwise(now - before)
    return F.when(F.size(samples) > 1, F.aggregate(steps, F.lit(0).cast("bigint"), add))


def _windowed_samples(df: DataFrame, keys: list[str], values: list[str], window: str, slide: str | None, lateness: str) -> DataFrame:
    """Samples of each key and window in time order.

    A window holds one sample per scrape of a key (repeats are dropped before),
    so the array is bounded by the window length over the scrape interval.
    """
    w = F.window("snap_ts", window, slide) if slide else F.window("snap_ts", window)
    return _late(df, lateness).groupBy(w, *keys).agg(
        F.sort_array(F.collect_list(F.struct("snap_ts", *values))).alias("samples"))


def counter_rate(df: DataFrame, keys: list[str], value: str = "value", window: str = "5 minutes", slide: str = "1 minute",
                 lateness: str = LATENESS) -> DataFrame:
    """Per-second growth of a counter in sliding windows, from the samples inside each window."""
    s = _windowed_samples(df, keys, [value], window, slide, lateness)
    first, last = F.element_at("samples", 1)["snap_ts"], F.element_at("samples", -1)["snap_ts"]
    seconds = (F.unix_micros(last) - F.unix_micros(first)) / 1_000_000
    return s.where(F.size("samples") > 1).select(
        *_bounds(), *keys, _in_order(F.col("samples"), value).alias("increase"), seconds.alias("seconds")).withColumn(
        "rate", F.try_divide(F.col("increase").cast("double"), "seconds"))


def hit_ratio_over_time(df: DataFrame, keys: list[str], window: str = "5 minutes", slide: str | None = None,
                        lateness: str = LATENESS) -> DataFrame:
    """Cache hit percentage of the reads that happened inside each window."""
    s = _windowed_samples(df, keys, ["blks_hit", "blks_read"], window, slide, lateness)
    grown = s.where(F.size("samples") > 1).select(
        *_bounds(), *keys, _in_order(F.col("samples"), "blks_hit").alias("hit"), _in_order(F.col("samples"), "blks_read").alias("read"))
    return grown.withColumn("hit_percent", percent("hit", F.col("hit") + F.col("read")))


def state_changes(df: DataFrame, keys: list[str], column: str, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """How often a state differs from the one before it, per window."""
    s = _windowed_samples(df, keys, [column], window, None, lateness)
    changed = F.filter(
        F.sequence(F.lit(2), F.size("samples")),
        lambda i: ~F.element_at("samples", i)[column].eqNullSafe(F.element_at("samples", i - 1)[column]))
    return s.where(F.size("samples") > 1).select(*_bounds(), *keys, F.size(changed).cast("bigint").alias("changes"))


def sustained_alerts(breaches: DataFrame, gap: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Breaches of one rule and object joined into sessions; kept when they last long enough.

    The gap is two scrape intervals, so one missed scrape does not end an alert.
    """
    keys = ["server_id", "metric", "object", "severity", "for_seconds"]
    sessions = _late(breaches, lateness).groupBy(F.session_window("snap_ts", gap), *keys).agg(
        n_rows().alias("samples"), F.max("value").alias("worst_value"),
        F.min("snap_ts").alias("first_breach"), F.max("snap_ts").alias("last_breach"))
    lasted = (F.unix_micros("last_breach") - F.unix_micros("first_breach")) / 1_000_000
    return sessions.where(lasted >= F.col("for_seconds")).select(
        *keys, "first_breach", "last_breach", lasted.alias("lasted_seconds"), "samples", "worst_value")


def blocking_episodes(pairs: DataFrame, gap: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """The same blocked and blocking session over consecutive scrapes, as one episode."""
    keys = ["server_id", "blocked_pid", "blocking_pid"]
    sessions = _late(pairs, lateness).groupBy(F.session_window("snap_ts", gap), *keys).agg(
        n_rows().alias("scrapes"), F.min("snap_ts").alias("first_seen"), F.max("snap_ts").alias("last_seen"))
    return sessions.select(
        *keys, "first_seen", "last_seen", "scrapes",
        ((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1_000_000).alias("lasted_seconds"))
