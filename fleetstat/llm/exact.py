"""Exact deduplication by a stream with keyed state.

The rows are first written as a content log: identifier, text, the SHA-256 of the
text without white space, its length and a locator (the row's number in the log).
A structured stream reads the narrow columns of the log. Its state is one entry
for each digest, never expires, and is kept by RocksDB on disk: how many rows
have the digest, and identifier and locator of the row that stays. Spark adds up
rows of one digest inside each input task before the shuffle, so a digest with a
third of all rows reaches its state as one row for each task.

On hits, that is for digests of two rows or more, full bytes are compared: the
normalised texts are read back from the log by locator, and the least and the
largest of a digest must be equal. A digest for which they differ is no proof of
equality, and its rows are grouped by their whole text instead.

Of equal texts the row with the most code points stays, then the smallest
identifier (a null identifier after all others), then the first in the log.

Defined results: a null text counts as empty; a repeated row is a row of its own,
and one of them stays; a null identifier stays null in the result; columns other
than identifier and text are neither read nor returned by `classes`; `deduplicated`
keeps the columns it is given; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstat.llm.common import scratch, text_of, written

#: State on disk; changes are saved for each micro-batch, and files take only the space they fill.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # One bound for all stores of an executor, however many partitions it holds; without it each has caches and buffers of its own.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
#: Bytes of the log that one micro-batch takes; a table of more is read in several, each of which consults the state of those before.
BATCH = 2 << 30


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def content_log(df: DataFrame, id_col: str, text_col: str, digest=None) -> tuple[DataFrame, str]:
    """Write the rows with identifier, digest, length and locator; the log and its folder."""
    spark = df.sparkSession
    path = scratch(spark, "log")
    text = text_of(text_col)
    digest = digest or (lambda c: F.sha2(c, 256))
    log = df.select(
        F.struct("*").alias("record"), F.col(id_col).alias("doc_id"), digest(normalised(text)).alias("digest"),
        F.length(text).alias("length"), F.monotonically_increasing_id().alias("locator"))
    log.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(log.schema).parquet(path), path


@contextmanager
def _disk_state(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def keyed_state(entries: DataFrame) -> DataFrame:
    """The state of a (streaming or stored) log: count and best row of each digest."""
    best = F.struct((-F.col("length")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_locator"))
    return entries.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))


def streamed_state(spark: SparkSession, log_path: str, schema, max_bytes: int = BATCH) -> DataFrame:
    """Run the stream over the log until it is read; the last state of each digest."""
    folder = scratch(spark, "state")
    entries = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(log_path).select("doc_id", "digest", "length", "locator")

    batches = []

    def keep(batch: DataFrame, number: int) -> None:
        batches.append(number)
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    with _disk_state(spark):
        query = (keyed_state(entries).writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    state = keyed_state(spark.createDataFrame([], schema)).schema
    updates = spark.read.schema(state).parquet(f"{folder}/updates") if batches else spark.createDataFrame([], state)
    # Counts only grow: the largest is the last. One micro-batch needs no further step.
    last = updates.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s")).select("digest", "s.group_size", "s.best")
    return last if len(batches) > 1 else updates


def _resolved(log: DataFrame, path: str, text_col: str, max_bytes: int) -> DataFrame:
    state = written(streamed_state(log.sparkSession, path, log.schema, max_bytes), "classes")
    narrow = log.select("doc_id", "digest", "length", "locator")
    body = normalised(F.coalesce(F.col("record").getField(text_col).cast("string"), F.lit("")))

    # Hits only: read the texts back by locator and compare whole bytes.
    hits = narrow.join(state.where("group_size > 1").select("digest"), "digest", "left_semi").select("locator")
    texts = log.join(hits, "locator", "left_semi").select("digest", body.alias("body"))
    unequal = written(
        texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest"), "unequal")
    columns = ("doc_id", "digest", "locator", "group_size", "best.keep_id", "best.keep_locator")
    clear = narrow.join(state.join(unequal, "digest", "left_anti"), "digest").select(*columns)
    if unequal.isEmpty():
        return clear.withColumn("kept", F.col("locator") == F.col("keep_locator"))

    # A digest that different texts share: whole texts are the groups.
    mixed = log.join(unequal, "digest", "left_semi").withColumn("body", body)
    groups = keyed_state(mixed.drop("digest").withColumnRenamed("body", "digest")).withColumnRenamed("digest", "body")
    split = mixed.join(groups, "body").select(*columns)
    return clear.unionByName(split).withColumn("kept", F.col("locator") == F.col("keep_locator"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, max_bytes: int = BATCH) -> DataFrame:
    """One row per row: doc_id, digest, locator, the identifier and locator that stay, group size, kept.

    `digest` replaces SHA-256 of the normalised text (for tests of colliding digests).
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    log, path = content_log(rows, "doc_id", "text", digest)
    return _resolved(log, path, "text", max_bytes)


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, max_bytes: int = BATCH) -> DataFrame:
    """The rows that stay, with all their columns."""
    log, path = content_log(df, id_col, text_col, digest)
    kept = _resolved(log, path, text_col, max_bytes).where("kept").select("locator")
    return log.join(kept, "locator", "left_semi").select("record.*")
