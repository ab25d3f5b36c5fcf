"""Two-pass external shuffle into equal shards.

Pass one scatters whole records into buckets that fit in memory: a seeded hash of
identifier and content picks one of a fixed number of cells, and cells are joined
or cut into buckets of about `bucket_bytes`. Pass two orders each bucket in a
fixed way, applies a seeded Fisher-Yates shuffle and writes it to the shared
folder. The row at place p of the whole order goes to shard p mod n, slot p div n
(law `rows`: counts at most one apart, slots gapless).

One bucket is one group of one task, bounded by its bytes whatever repeats: a
cell that holds far more than its share (one row repeated many times) is dealt
to several buckets by the place of its rows in the input. The driver sees the
sizes of the cells and buckets only, never rows.

Defined results: null identifiers and texts are hashed as such; repeated rows are
separate records; an empty table gives no rows. Records are carried as one
struct, so extra columns with any names stay with their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import written

#: The fixed grid whose sizes are measured before pass one.
CELLS = 4096
BUCKET_BYTES = 64 << 20
#: A cell of so many times the mean is taken for one that a hash cannot split.
SKEWED = 8


def _packed(df: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """Record, a hash that places it, and its size."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)))
    return df.select(F.struct("*").alias("record"), place.alias("place"), size.alias("size"))


def _plan(sizes: dict[int, int], bucket_bytes: int) -> tuple[list[int], list[int], list[bool], int]:
    """First bucket, number of buckets and whether skewed, for each cell."""
    total = sum(sizes.values())
    wanted = max(1, -(-total // bucket_bytes))
    share = total / wanted
    first, count, skewed = [0] * CELLS, [1] * CELLS, [False] * CELLS
    bucket, filled = 0, 0.0
    for cell in range(CELLS):
        n = sizes.get(cell, 0)
        if n > share:
            if filled:
                bucket, filled = bucket + 1, 0.0
            first[cell], count[cell] = bucket, -(-n // int(share + 1))
            skewed[cell] = n > SKEWED * total / CELLS
            bucket += count[cell]
            continue
        if filled + n / 2 > share:
            bucket, filled = bucket + 1, 0.0
        first[cell] = bucket
        filled += n
    return first, count, skewed, bucket + 1


def _cell(place: Column) -> Column:
    return F.pmod(place, F.lit(CELLS)).cast("int")


def fisher_yates(rng: np.random.Generator, n: int) -> np.ndarray:
    """A uniform order of n places: each place from the last is exchanged with one not after it."""
    order = np.arange(n)
    others = rng.integers(0, np.arange(1, n + 1)) if n else order
    for i in range(n - 1, 0, -1):
        j = others[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(df: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Both passes: the written records with bucket and place in it, and the first global place of each bucket."""
    spark = df.sparkSession
    packed = _packed(df, id_col, text_col, seed)
    sizes = {r["cell"]: r["bytes"] for r in packed.groupBy(_cell(F.col("place")).alias("cell")).agg(F.sum("size").alias("bytes")).collect()}
    first, count, skewed, _ = _plan(sizes, bucket_bytes)
    cells = F.broadcast(spark.createDataFrame(list(zip(range(CELLS), first, count, skewed)), "cell int, first long, count long, skewed boolean"))

    # Inside a cell of several buckets the rest of the hash decides, or the place in the input where hashes are all alike.
    spread = F.when(F.col("skewed"), F.monotonically_increasing_id()).otherwise(F.shiftrightunsigned("place", 12))
    dealt = packed.withColumn("cell", _cell(F.col("place"))).join(cells, "cell").select(
        "record", "place", (F.col("first") + F.pmod(spread, F.col("count"))).alias("bucket"))
    schema = dealt.select("record", "bucket", F.lit(0).cast("long").alias("position")).schema

    def shuffle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("place")
        key = bucket.column("bucket")[0].as_py()
        order = fisher_yates(np.random.default_rng([seed, key]), len(bucket))
        mixed = bucket.select(["record", "bucket"]).take(pa.array(order))
        return mixed.append_column("position", pa.array(np.arange(len(mixed))))

    records = written(dealt.groupBy("bucket").applyInArrow(shuffle, schema), "shuffle")
    counts = sorted((r["bucket"], r["n"]) for r in records.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for bucket, n in counts:
        starts.append((bucket, at))
        at += n
    return records, spark.createDataFrame(starts, "bucket long, start long")


def shard(df: DataFrame, n_shards: int = 16, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records with their shard and slot. A bucket has one start, so what is broadcast is bytes / bucket_bytes rows."""
    if n_shards < 1:
        raise ValueError("at least one shard")
    records, starts = shuffled(df, seed, bucket_bytes, id_col, text_col)
    place = F.col("start") + F.col("position")
    return records.join(F.broadcast(starts), "bucket").select(
        "record", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order inside each file."""
    rows = sharded.select("record.*", "shard", "slot") if not {"shard", "slot"} & set(sharded.schema["record"].dataType.names) else sharded
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col("record").getField(text_col)
    return sharded.select(
        F.col("record").getField(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
