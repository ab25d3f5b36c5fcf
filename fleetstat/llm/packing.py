"""Best-fit packing of token sequences, by levels.

A document is its token ids and an end id; only documents above the capacity are
cut. Level by level, items are dealt to groups of bounded size and each group is
packed best-fit decreasing. Bins that are nearly full are finished; underfull bins
become the items of the next level, where the groups of several neighbours are
merged, until one group is left. A group hands on at most `handed` bins, its
emptiest, and finishes the others, so a merged group has at most fan_in * handed
items whatever the corpus.

With `handed` >= fan_in this bound costs no sequence. Best fit leaves at most one bin
of a group half full or less: a second one's first item would have gone into the
first. Two bins above one half never join, so every join of a merged group takes
one of its at most fan_in small bins. A small bin that fits a finished bin fits
every bin its group handed on, as those have more room, and there are at least as
many of them as small bins. The small bins themselves are always handed on.

Only lengths take part in packing; token bytes stay with their piece. A bin is
named after its first item, so names are unique without coordination, and the
place of a piece is the sum of its offsets along the levels.

Defined results: a null or empty text is one piece holding the end id alone; a
repeated row is packed again; a null identifier stays null; columns other than
identifier and text are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.bpe import encoded_batches
from fleetstat.llm.common import text_of, written

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 20_000
FAN_IN = 8
HANDED = 2_000
NEARLY_FULL = 0.995


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, tokens (little-endian unsigned 32-bit ids) of every whole text."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    step, end = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches):
        for part, ids in encoded_batches(batches, path, 1):
            whole = [b + end for b in ids]
            cuts = [(i, k) for i, b in enumerate(whole) for k in range(-(-len(b) // step))]
            tokens = [whole[i][k * step:(k + 1) * step] for i, k in cuts]
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array([i for i, _ in cuts], pa.int32())), pa.array([k for _, k in cuts], pa.int32()),
                pa.array([k * capacity for _, k in cuts], pa.int64()), pa.array([len(t) // 4 for t in tokens], pa.int64()),
                pa.array(tokens, pa.binary())], ["doc_id", "piece", "start", "length", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, tokens binary")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of each item, and what each bin holds.

    `open_at` has the open bins by room left; the rooms in use are the bits of one number,
    so the tightest bin that takes an item is the lowest bit from the item's length on.
    """
    where, offset, held = [0] * len(lengths), [0] * len(lengths), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            b, room = len(held), capacity
            held.append(0)
        where[i], offset[i] = b, held[b]
        held[b] += n
        if room > n:
            open_at[room - n].append(b)
            rooms |= 1 << (room - n)
    return where, offset, held


def _packed(group: pa.Table, capacity: int, last: bool, handed: int, nearly: float) -> pa.Table:
    """Pack one group; adds bin, offset, what the bin holds, and whether it is handed on."""
    group = group.sort_by("item")
    items = group.column("item").to_pylist()
    where, offset, held = best_fit(group.column("length").to_pylist(), capacity)
    name = [0] * len(held)
    for i, b in enumerate(where):
        if offset[i] == 0:
            name[b] = items[i]
    under = sorted((h, b) for b, h in enumerate(held) if h < nearly * capacity)
    on = set() if last else {b for _, b in under[:handed]}
    return (group.append_column("bin", pa.array([name[b] for b in where], pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
            .append_column("held", pa.array([held[b] for b in where], pa.int64()))
            .append_column("on", pa.array([b in on for b in where], pa.bool_())))


def _level(items: DataFrame, capacity: int, last: bool, handed: int, nearly: float) -> DataFrame:
    schema = items.select("*", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("on")).schema
    return written(items.groupBy("group").applyInArrow(lambda t: _packed(t, capacity, last, handed, nearly), schema), "packed")


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN, handed: int = HANDED, nearly: float = NEARLY_FULL) -> DataFrame:
    """Items (item: unique long, length: 1 to capacity, any other columns) with sequence_id and offset."""
    if handed < fan_in:
        raise ValueError("a group hands on at least as many bins as groups are merged")
    groups = max(1, math.ceil(items.count() / group_rows))
    extra = [c for c in items.columns if c not in ("item", "length")]
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("long"))
    level = _level(dealt, capacity, groups == 1, handed, nearly)
    placed = level.select("item", "length", *extra, F.col("bin").alias("sequence_id"), "offset")
    while groups > 1:
        groups = math.ceil(groups / fan_in)
        under = level.where("on and offset = 0").select(F.col("bin").alias("item"), F.col("held").alias("length"), F.floor(F.col("group") / fan_in).cast("long").alias("group"))
        level = _level(under, capacity, groups == 1, handed, nearly)
        moved = level.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        placed = placed.join(moved, "sequence_id", "left").select(
            "item", "length", *extra, F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return placed


def sequences(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = True, **options) -> DataFrame:
    """One row per piece with its place; `with_tokens=False` keeps only a checksum of the tokens."""
    made = pieces(df, path, capacity, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("tokens"))
    kept = ["doc_id", "piece", "start", "ids_crc32", *(["tokens"] if with_tokens else [])]
    stored = written(made.select(F.monotonically_increasing_id().alias("item"), "length", *kept), "pieces")
    if not with_tokens:
        return pack(stored, capacity, **options)
    placed = pack(stored.select("item", "length"), capacity, **options).drop("length")
    return stored.join(placed, "item")


def report(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
