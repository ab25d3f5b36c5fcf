"""How quality filters interact, for every order they could run in, by packed counters.

Each document fails a set of filters, its mask. A mask and the document's labels decide
every outcome in every order and step: whether it is kept, removed there, redundant and
so on. So each (mask, labels) has one big integer whose 64-bit fields hold all outcomes
of all steps (with five filters 120 orders of five steps, 600 fields a counter), and the
report of a part is the sum of its documents' integers. Fields cannot overflow below
2^64 documents.

Only the filter "repeats the text of a smaller identifier" needs other rows. Texts
become digests (SHA-256) inside the scan, so what is shuffled is one short row for each
document. Copies share the other filters' outcome, hence a group of copies is summed to
a row for each part and label before its least identifier is looked up: neither a text
repeated millions of times nor a part with most rows puts its rows into one task. Sums
are made per task, then per 64 shares of a part, then per part.

Defined results: a null text is empty; a null part is the empty string; a null identifier
is smaller than none and has no smaller one; rows that share identifier and text both
stay; a document is good (toxic) if any row of its labels says so; labels of unknown
documents, null labels and other columns are ignored; a table without rows has no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of

FILTERS = "ABCDE"
#: The filter that compares documents; all others look at one text.
REPEATED = "E"
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
WIDTH = 8
#: Parts that a task sums at once, and shares of a part in the middle level of sums.
HELD, SHARES = 256, 64

_UPPER = bytes(range(65, 91))
#: Bytes that go on with a character.
_GOING_ON = bytes(range(128, 192))
# Fixed value: the symbols filter D looks for.
_SYMBOLS = b"#$%&*|"


def failures(text: bytes) -> int:
    """Bits of the filters other than E that a text (UTF-8) fails."""
    words = text.split()
    points = len(text.translate(None, _GOING_ON))
    upper = len(text) - len(text.translate(None, _UPPER))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * points, symbols > 0)
    return sum(1 << i for i, f in enumerate(fails) if f)


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text and the filters it fails by itself."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for start, end in slices([len(t) if (t := s.as_buffer()) is not None else 0 for s in texts]):
                part = batch.slice(start, end - start)
                raw = texts.slice(start, end - start).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()),
                    pa.array([failures(t) for t in raw], pa.int32())], ["doc_id", "part", "digest", "mask"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int")


def outcomes(documents: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents counted by part, full mask and labels, copies of a text together: part, mask, good, toxic, n."""
    if labels is None:
        labelled = documents.select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    else:
        said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        labelled = documents.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    cell = ["digest", "part", "mask", "good", "toxic"]
    copies = labelled.groupBy(*cell, "doc_id").agg(F.count("*").alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    cells = copies.groupBy(*cell).agg(
        F.sum("n").alias("n"), F.min(known).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("unknown"))
    # A cell with a smaller identifier elsewhere fails whole, the cell of the least one but for the rows of that identifier.
    least = cells.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    passed = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.coalesce("unknown", F.lit(0))
    settled = cells.join(least, "digest").select("part", "mask", "good", "toxic", F.array(
        F.struct(F.lit(0).alias("repeated"), passed.alias("n")),
        F.struct(F.lit(1 << FILTERS.index(REPEATED)).alias("repeated"), (F.col("n") - passed).alias("n"))).alias("both"))
    return settled.select("part", "good", "toxic", "mask", F.inline("both")).where("n > 0").select(
        "part", (F.col("mask") + F.col("repeated")).alias("mask"), "good", "toxic", "n")


def orders() -> list[str]:
    return ["".join(o) for o in itertools.permutations(FILTERS)]


@functools.lru_cache(maxsize=4 << len(FILTERS))
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The integer of one document: a one in each field whose outcome it has."""
    fields = np.zeros((len(COUNTERS), len(orders()), len(FILTERS)), dtype=f"<u{WIDTH}")
    kept, removed, redundant, unique, good_lost, toxic_lost = fields
    for o, order in enumerate(orders()):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            here = fails and not gone
            removed[o, s], redundant[o, s], unique[o, s] = here, fails and gone, mask == bit
            good_lost[o, s], toxic_lost[o, s] = here and good, here and toxic
            gone = gone or fails
            kept[o, s] = not gone
    return int.from_bytes(fields.tobytes(), "little")


def _size() -> int:
    return WIDTH * len(COUNTERS) * len(orders()) * len(FILTERS)


def _rows(totals: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(list(totals), pa.string()), pa.array([t.to_bytes(_size(), "little") for t in totals.values()], pa.binary())], ["part", "total"])


def packed_sums(counted: DataFrame) -> DataFrame:
    """Each task's sums of its documents' integers: part, total. A task holds few parts; beyond, a part has several sums."""
    def run(batches: Iterator[pa.RecordBatch]):
        totals: Counter[str] = Counter()
        for batch in batches:
            for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in totals and len(totals) == HELD:
                    yield _rows(totals)
                    totals = Counter()
                # Copies add their integer so many times at once.
                totals[part] += n * packed(mask, good, toxic)
        if totals:
            yield _rows(totals)
    return counted.select("part", "mask", "good", "toxic", "n").mapInArrow(run, "part string, total binary")


def merged(sums: DataFrame, *keys) -> DataFrame:
    """Sums of sums: rows of a key meet in one task, which adds them up part by part."""
    def run(batches: Iterator[pa.RecordBatch]):
        rows = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for part, same in itertools.groupby(rows, key=lambda r: r[0]):
            yield _rows({part: sum(int.from_bytes(total, "little") for _, total in same)})
    return sums.repartition(*keys).sortWithinPartitions("part").select("part", "total").mapInArrow(run, "part string, total binary")


def unpacked(sums: DataFrame) -> DataFrame:
    """A row for each part, order and step with all counters."""
    names = orders()
    steps = len(FILTERS)
    letters = np.array([[FILTERS.index(c) for c in o] for o in names])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fields = np.frombuffer(total, dtype=f"<u{WIDTH}").reshape(len(COUNTERS), len(names), steps).astype(np.int64)
                removed = fields[COUNTERS.index("removed")]
                by_filter = np.array([removed[letters == f].sum() for f in range(steps)])
                columns = [pa.array(f.ravel()) for f in fields]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * letters.size, pa.string()), pa.array([n for n in names for _ in range(steps)], pa.string()),
                    pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))), *columns, pa.array(by_filter[letters].ravel())],
                    ["part", "filter_order", "step", *COUNTERS, "shapley"])

    return sums.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley")))


def audit(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counters of every part, order and step."""
    counted = outcomes(masks(df, id_col, text_col, part_col), labels, id_col)
    by_task = packed_sums(counted).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    return unpacked(merged(merged(by_task, "part", "share"), "part"))
