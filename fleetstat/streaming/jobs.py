"""Streaming jobs: snapshot files in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetstat.functions import SNAP
from fleetstat.operators.joins import blocking_pairs


def append_to(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends closed windows to a Parquet table and can resume from its checkpoint."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def blocking_pair_writer(locks: DataFrame, load_activity, path: str, checkpoint: str) -> DataStreamWriter:
    """Blocking pairs of every scrape, appended to a table that ``blocking_episodes`` reads.

    Lock rows are stored by day and scrape as they come, and every scrape that a
    batch touches is paired anew from all its stored rows, so a scrape split over
    two batches keeps its pairs. Only the folders of those scrapes are listed and
    read, whatever the length of the history; their names are as many as the
    folders the batch wrote. Sessions are read for the days of the batch only.
    A batch replayed after a failure rewrites its own rows and its scrapes'
    folders, so the tables hold everything exactly once.
    """
    seen = f"{path}_locks"
    scrape = F.date_format("snap_ts", "HHmmss.SSSSSS")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("snap_date", F.to_date("snap_ts")).withColumn("scrape", scrape).withColumn("batch_id", F.lit(batch_id))
        (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date", "scrape", "batch_id").parquet(seen))
        open_ = dated.select(F.date_format("snap_date", "yyyy-MM-dd").alias("day"), "scrape").distinct().collect()
        if not open_:
            return
        days = sorted({r["day"] for r in open_})
        folders = [f"{seen}/snap_date={r['day']}/scrape={r['scrape']}" for r in open_]
        locks = spark.read.schema(dated.schema).option("basePath", seen).parquet(*folders)
        sessions = load_activity()
        day = F.col("snap_date") if "snap_date" in sessions.columns else F.to_date("snap_ts")
        activity = sessions.where(day.isin([F.to_date(F.lit(d)) for d in days])).join(locks.select(*SNAP).distinct(), SNAP, "left_semi")
        pairs = blocking_pairs(locks, activity).select(
            *[F.col(f"l.{c}") for c in SNAP], F.col("l.pid").alias("blocked_pid"), F.col("r.pid").alias("blocking_pid")).distinct()
        (pairs.withColumn("snap_date", F.to_date("snap_ts")).withColumn("scrape", scrape)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date", "scrape").parquet(path))

    return locks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
