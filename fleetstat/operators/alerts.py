"""Threshold rules over metric samples, for stored and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetstat.operators.history import with_previous

KEYS = ["server_id", "metric", "object", "severity", "for_seconds"]


def breached() -> Column:
    low, high, value = F.col("low"), F.col("high"), F.col("value")
    strict = (low.isNull() | (value > low)) & (high.isNull() | (value < high))
    closed = (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
    return F.when(F.col("inclusive"), closed).otherwise(strict)


def evaluate_alerts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples (metric, value, …) with every rule they breach. The measured size of the rules picks the join."""
    return samples.join(rules, "metric").where(breached())


def judged(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Every sample once for each rule about its metric, and whether it breaches it."""
    return samples.join(rules, "metric").select(*KEYS, "snap_ts", "value", F.coalesce(breached(), F.lit(False)).alias("breach"))


def lasting_alerts(samples: DataFrame, rules: DataFrame, gap: str = "1 hour", bucket: str = "day") -> DataFrame:
    """Every scrape at which a breach has lasted as long as its rule asks, with the scrape it began at.

    An alert fires while the breach lasts, also if it never ends. A sample inside the limits ends it, and so does a
    time without samples longer than ``gap``. Runs are found inside (object, day); one row per day carries the begin
    of a run over midnight, so no task sorts the whole history of an object.
    """
    paired = with_previous(judged(samples, rules), KEYS, ["snap_ts", "value"], ["breach"], bucket)
    silent = F.col("prev.snap_ts") < F.col("snap_ts") - F.expr(f"INTERVAL {gap}")
    begins = F.col("breach") & (F.col("prev").isNull() | ~F.coalesce(F.col("prev.breach"), F.lit(False)) | silent)
    marked = paired.withColumn("_begin", F.when(begins, F.col("snap_ts"))).withColumn("_bucket", F.date_trunc(bucket, "snap_ts"))
    inside = Window.partitionBy(*KEYS, "_bucket").orderBy("snap_ts", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*KEYS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*KEYS, "_bucket").agg(F.max("_begin").alias("_last")).select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(KEYS)], F.col("_bucket").alias("_of"), F.max("_last").over(earlier).alias("_carried"))
    same = F.col("_bucket") == F.col("_of")
    for i, k in enumerate(KEYS):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    since = F.coalesce("_within", "_carried")
    lasted = (F.unix_micros("snap_ts") - F.unix_micros("since")) / 1_000_000
    return (
        marked.withColumn("_within", F.max("_begin").over(inside)).join(carried, same, "left").withColumn("since", since)
        .withColumn("lasted_seconds", lasted).where(F.col("breach") & (F.col("lasted_seconds") >= F.col("for_seconds")))
        .select(*KEYS, "snap_ts", "value", "since", "lasted_seconds"))
