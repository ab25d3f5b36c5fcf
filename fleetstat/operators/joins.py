"""Joins that need care with NULL keys, hot keys or settings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP

LOCK_OBJECT = [
    "locktype", "database", "relation", "page", "tuple", "virtualxid",
    "transactionid", "classid", "objid", "objsubid",
]

# A key is hot when it holds more than this share of all rows, so there can be
# at most HOT_LIMIT hot keys whatever the size of the data.
HOT_LIMIT = 1024
# Rows of either side that one cell of a hot key's grid takes, at least.
CELL = 4096


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted by its keys, never collected on the driver and sent to every task.

    For joins whose sides both grow. Spark guesses the size of a side from the stored columns, before texts are built
    and arrays exploded; a few narrow, well compressed columns make that guess hundreds of times too low.
    """
    return df.hint("merge")


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """Keys with more than 1/HOT_LIMIT of the rows (at most HOT_LIMIT of them) and the size of each one's grid.

    ``left`` and ``right`` tell which rows are on either side. A cell takes CELL rows of a side, or the hot
    share where that is more, so a key has as many lines and columns as its own counts ask for, and one cell
    where both are small.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(left).alias("_l"), F.count_if(right).alias("_r"))
    total = counts.agg(F.sum("_n"))  # from the counts, so the same shuffle serves both
    cell = F.greatest(F.lit(CELL), F.floor(total.scalar() / HOT_LIMIT))
    sized = counts.where((F.col("_n") * HOT_LIMIT > total.scalar()) & (F.col("_l") > 0) & (F.col("_r") > 0))
    return sized.select(
        *keys, F.ceil(F.col("_l") / cell).cast("int").alias("_lines"), F.ceil(F.col("_r") / cell).cast("int").alias("_columns")
    ).where("_lines > 1 OR _columns > 1")


def salted_pairs(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, left_id: Column, right_id: Column) -> DataFrame:
    """All (left, right) rows equal on ``keys``, as aliases l and r. ``hot`` comes from ``hot_keys``.

    Rows of a hot key are spread over its grid: a left row takes one line of it
    and a right row one column, so every pair meets in exactly one cell. Cell
    numbers come from row content, so a re-run task repeats them.
    """
    hot = F.broadcast(hot)

    def spread(df: DataFrame, row_id: Column, own: str, others: str) -> DataFrame:
        marked = df.join(hot, keys, "left")
        return marked.select(
            *df.columns, F.pmod(F.xxhash64(row_id), F.coalesce(f"_{own}s", F.lit(1))).cast("int").alias(f"_{own}"),
            F.explode(F.sequence(F.lit(0), F.coalesce(f"_{others}s", F.lit(1)) - 1)).alias(f"_{others}"))

    l = spread(left, left_id, "line", "column").alias("l")
    r = spread(right, right_id, "column", "line").alias("r")
    same = reduce(and_, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_line", "_column"]])
    return l.join(r, same)


def with_object(locks: DataFrame, keys: int) -> DataFrame:
    return locks.withColumn("_object", F.xxhash64(*LOCK_OBJECT[:keys]))


def locked_objects(locks: DataFrame, activity: DataFrame, keys: int, *session: str) -> DataFrame:
    """Locks with columns of their session and a digest of the locked object.

    Joins run on the digest, one number instead of ten nullable columns; the
    columns themselves are compared afterwards, NULL being equal to NULL.
    """
    named = with_object(locks, keys).select(*SNAP, "pid", *LOCK_OBJECT, "mode", "granted", "_object")
    return named.join(activity.select(*SNAP, "pid", *session), [*SNAP, "pid"])


def blocking_pairs(locks: DataFrame, activity: DataFrame, keys: int = 10, require_granted: bool = False) -> DataFrame:
    """Waiting sessions with every other session holding or awaiting the same object.

    ``keys`` takes the first n columns naming the locked object. Sessions are
    attached before the pairing, so locks without a session never multiply.
    The result is as large as waiters x holders of each object: that list is
    what the report is, and the pairing spreads a hot object over many tasks.
    """
    held = locked_objects(
        locks, activity, keys, "usename", "query", "query_start", "wait_event", "wait_event_type", "application_name", "state")
    waiting = held.where(~F.col("granted"))
    others = held.where(F.col("granted")) if require_granted else held
    row_id = F.struct("pid", "mode")
    on = [*SNAP, "_object"]
    # Counted on the locks alone: the sessions could only make an object less hot.
    others_too = F.col("granted") if require_granted else F.lit(True)
    hot = hot_keys(with_object(locks, keys).select(*on, "granted"), on, ~F.col("granted"), others_too)
    pairs = salted_pairs(waiting, others, on, hot, row_id, row_id)
    return pairs.where(null_safe("l", "r", LOCK_OBJECT[:keys]) & (F.col("l.pid") != F.col("r.pid")))


def blocked_sessions(locks: DataFrame, activity: DataFrame, keys: int = 10) -> DataFrame:
    """Waiting locks that at least one other session competes for, without listing the competitors.

    The lowest and highest process of each object tell whether another one is
    there, so the work stays linear in the number of locks.
    """
    held = locked_objects(locks, activity, keys, "query_start")
    ends = held.groupBy(*SNAP, "_object", *LOCK_OBJECT[:keys]).agg(F.min("pid").alias("_low"), F.max("pid").alias("_high"))
    on = [*SNAP, "_object"]
    met = held.where(~F.col("granted")).alias("l").join(
        ends.alias("r"), reduce(and_, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]) & null_safe("l", "r", LOCK_OBJECT[:keys]))
    return met.where((F.col("_low") != F.col("l.pid")) | (F.col("_high") != F.col("l.pid"))).select("l.*")


def pivot_settings(settings: DataFrame, *names: str, units: bool = False) -> DataFrame:
    """One row per server with a column per named setting (and ``<name>_unit``)."""
    picked = settings.where(F.col("name").isin(*names))
    columns = []
    for name in names:
        here = F.col("name") == name
        columns.append(F.max(F.when(here, F.col("setting"))).alias(name))
        if units:
            columns.append(F.max(F.when(here, F.col("unit"))).alias(f"{name}_unit"))
    return picked.groupBy(*SNAP).agg(*columns)


def with_settings(df: DataFrame, settings: DataFrame, *names: str) -> DataFrame:
    """Attach settings of the row's own server; absent settings are NULL."""
    return df.join(shuffled(pivot_settings(settings, *names)), SNAP, "left")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Pair two snapshots by key; objects present on one side only keep NULLs on the other."""
    b = before.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values])
    a = after.select(*keys, *[F.col(v).alias(f"{v}_after") for v in values])
    joined = b.join(a, keys, "full")
    return joined.select(
        *keys,
        *[c for v in values for c in (
            F.col(f"{v}_before"), F.col(f"{v}_after"),
            (F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_change"))],
    )


def validate_foreign_key(child: DataFrame, parent: DataFrame, child_columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child keys without a parent, with the number of rows behind each; NULL keys are allowed.

    Keys are counted before the anti join, so a hot key crosses the network once.
    """
    keyed = child.dropna(subset=child_columns).groupBy(*child_columns).agg(F.count(F.lit(1)).alias("orphan_rows"))
    renamed = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, child_columns)]).dropna()
    return keyed.join(renamed, child_columns, "left_anti")
