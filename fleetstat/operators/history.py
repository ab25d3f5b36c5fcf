"""Counters and measures over many snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], bucket: str = "day") -> DataFrame:
    """Attach the previous sample of the same key as the struct ``prev``.

    A plain lag would sort the whole history of a key in one task. Samples are
    cut into time buckets instead: the lag runs inside (key, bucket), and only
    the first sample of a bucket takes the last sample of the bucket before it,
    found from one row per bucket.
    """
    cut = df.withColumn("_bucket", F.date_trunc(bucket, order[0]))
    sample = F.struct(*order, *values)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    lasts = cut.groupBy(*keys, "_bucket").agg(F.max(sample).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = lasts.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_of"), F.lag("_last").over(across).alias("_carried"))
    # A NULL in a key is a key like any other.
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return (
        cut.withColumn("_lag", F.lag(sample).over(inside))
        .join(carried, same, "left")
        .withColumn("prev", F.coalesce("_lag", "_carried"))
        .drop("_lag", "_carried", "_bucket", "_of", *[f"_key_{i}" for i in range(len(keys))]))


def increment(current: Column, previous: Column, reset: Column | None = None) -> Column:
    """Growth of a cumulative counter; after a reset the counter restarts from zero."""
    restarted = current < previous
    if reset is not None:
        restarted = restarted | F.coalesce(reset, F.lit(False))
    return F.when(previous.isNotNull(), F.when(restarted, current).otherwise(current - previous))


def counter_delta(df: DataFrame, keys: list[str], counters: list[str], time: str = "snap_ts", tie: str | None = None,
                  stats_reset: str | None = None, bucket: str = "day") -> DataFrame:
    """Increment of every counter since the previous sample, and the seconds between; NULL for a first sample."""
    order = [time] + ([tie] if tie else [])
    carried = counters + ([stats_reset] if stats_reset else [])
    paired = with_previous(df, keys, order, carried, bucket)
    reset = None
    if stats_reset:
        reset = ~F.col(stats_reset).eqNullSafe(F.col(f"prev.{stats_reset}")) & F.col("prev").isNotNull()
    out = paired.withColumn("prev_ts", F.col(f"prev.{time}"))
    for c in counters:
        out = out.withColumn(f"{c}_delta", increment(F.col(c), F.col(f"prev.{c}"), reset))
    seconds = (F.unix_micros(time) - F.unix_micros("prev_ts")) / 1_000_000
    return out.withColumn("seconds", seconds).drop("prev")


def degradation(df: DataFrame, keys: list[str], total: str, count: str, time: str = "snap_ts", period: str = "month",
                baseline: int = 3) -> DataFrame:
    """Mean per period against the mean of the ``baseline`` periods before it.

    Samples are summed per period first, so the window sees one row per period.
    """
    periods = df.groupBy(*keys, F.date_trunc(period, time).alias("period")).agg(
        F.sum(total).alias("period_total"), F.sum(count).alias("period_count"))
    w = Window.partitionBy(*keys).orderBy("period")
    before = w.rowsBetween(-baseline, -1)
    mean = F.try_divide(F.col("period_total").cast("double"), F.col("period_count").cast("double"))
    base = F.try_divide(F.sum("period_total").over(before).cast("double"), F.sum("period_count").over(before).cast("double"))
    return periods.select(*keys, "period", "period_count", mean.alias("mean"), base.alias("baseline_mean")).withColumn(
        "ratio", F.try_divide("mean", "baseline_mean"))


def growth_trend(df: DataFrame, keys: list[str], size: str, time: str = "snap_ts", limit: Column | None = None) -> DataFrame:
    """Growth per day by least squares, and days until ``limit`` is reached at that pace."""
    day = F.unix_timestamp(time) / 86400
    trend = df.groupBy(*keys).agg(
        F.regr_slope(F.col(size).cast("double"), day).alias("bytes_per_day"), F.count(F.lit(1)).alias("samples"),
        F.max_by(size, F.struct(time, size)).alias("latest_bytes"))
    if limit is None:
        return trend
    return trend.withColumn("days_to_limit", F.when(F.col("bytes_per_day") > 0, (limit - F.col("latest_bytes")) / F.col("bytes_per_day")))
