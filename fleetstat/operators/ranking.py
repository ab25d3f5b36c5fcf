"""Top-k, shares and totals per snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetstat.functions import SNAP, percent


def top_k(df: DataFrame, k: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """First k rows of every snapshot in the given order.

    Written as a row number filter, which Spark turns into a limit inside every
    input partition before the shuffle: a snapshot holding most of the rows
    still sends at most k rows per partition to its final task.
    """
    w = Window.partitionBy(*(by or SNAP)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def with_total(df: DataFrame, source: DataFrame, by: list[str] | None = None, **totals: Column) -> DataFrame:
    """Attach per-snapshot aggregates of ``source`` to the rows of ``df``.

    The totals are partially aggregated where the data lies, and adaptive
    execution picks the join from their measured size. A window over the whole
    snapshot would send every row of a big snapshot to one task.
    """
    keys = by or SNAP
    sums = source.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    return df.join(sums, keys)


def count_share(df: DataFrame, keys: list[str], count: str, share: str) -> DataFrame:
    """Rows per group and the group's percentage of its snapshot."""
    groups = df.groupBy(*SNAP, *keys).agg(F.count(F.lit(1)).alias(count))
    shares = with_total(groups, groups, _total=F.sum(count))
    return shares.withColumn(share, percent(count, "_total")).drop("_total")


def share_of_total(df: DataFrame, source: DataFrame, value: str, share: str) -> DataFrame:
    summed = with_total(df, source, _total=F.sum(F.col(value).cast("decimal(38,0)")))
    return summed.withColumn(share, percent(value, "_total")).drop("_total")
