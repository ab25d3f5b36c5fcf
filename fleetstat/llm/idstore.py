"""Token ids in raw binary files with a minimal perfect hash index over document keys.

A store is a folder:

* `ids-*.bin`: raw ids of whole documents in ascending key order, little-endian, two
  bytes each if the vocabulary allows, else four; then the place of each document in
  the file (unsigned 64-bit, one more than documents) and their number (unsigned 64-bit);
* `keys-*.idx`: for each part of the key space a minimal perfect hash function and its
  entries: fingerprint of the key, shard, record in the shard, ids before it, and the
  last shard and record of the same key;
* `shards` and `parts`: Parquet tables that name the files that count.

The hash function has levels of bits: a key whose bit no other key of its level shares
owns it, all others go on to the next level, and the number of bits set before a key's
bit is its entry. An access reads a few words whatever the size: the part of the key,
one bit for each level until one is set, one entry, one stretch of ids.

Ids and keys are written inside Spark tasks. A repeated or lost attempt writes files
under new names, and only names that the tables hold are ever read, so executors may
be lost at any time. Documents reach their files by range partitioning of (key, hash
of the text, place in the input), so a key with very many rows is dealt to several
shards; parts of the index hold about `part_keys` distinct keys each. The driver sees
counts only.

Defined results: a null or empty text is the end id alone; a null key is a key of its
own, before all others; rows with equal keys are all stored, in the order of a hash of
their texts, and an access to the key returns them all; an unknown key gives no row;
other columns are neither read nor stored; an empty table gives a store without files.
Texts are encoded whole.
"""

from __future__ import annotations

import functools
import math
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetstat.llm.bpe import encoded_batches, vocabulary
from fleetstat.llm.common import text_of, written

END_ID = 2
SHARD_BYTES = 128 << 20
#: Documents of a shard at most, which bounds what a task holds of their places.
SHARD_DOCS = 1 << 20
PART_KEYS = 1 << 15
#: Bytes read at once from a shard.
SPAN_BYTES = 8 << 20
#: Tasks that read a store at most; beyond, a task reads several shards.
READERS = 10_000
#: Bits of a level for each key that reaches it.
ROOM = 2
MAGIC = b"KEYS0001"
LEVELS = 96
ENTRY = np.dtype([("print", "<u8"), ("shard", "<u4"), ("record", "<u4"), ("offset", "<u8"), ("last_shard", "<u4"), ("last_record", "<u4")])


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder name and the folder's path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(folder).path)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


# Keys and their minimal perfect hash functions.

def hashes(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a hash of each key; keys are equal if their kind and text are."""
    raw = b"".join(xxhash.xxh3_128_digest(b"\0" if k is None else b"\1" + str(k).encode()) for k in keys)
    both = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _bit(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return _mix(a + np.uint64(level) * (b | np.uint64(1))) % np.uint64(size)


@dataclass
class PerfectHash:
    """Bits of all levels one after the other, and how many are set before each word of 64."""

    sizes: list[int]
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(a):
            if len(sizes) == LEVELS:
                raise ValueError("two keys share a 128-bit hash")
            size = -(-ROOM * len(a) // 64) * 64
            at = _bit(a, b, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[at.astype(np.int64)]
            a, b = a[rest], b[rest]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, (np.cumsum(counts) - counts).astype("<u4"))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1 where no level has its bit."""
        found = np.full(len(a), -1, dtype=np.int64)
        left, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = _bit(a[left], b[left], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[hit]] = self.before[word[hit]] + np.bitwise_count(below[hit])
            left, base = left[~hit], base + size // 64
        return found


def _index_bytes(function: PerfectHash, entries: np.ndarray) -> list[bytes]:
    head = MAGIC + struct.pack("<QQ", len(entries), len(function.sizes)) + np.array(function.sizes, "<u8").tobytes()
    return [head, function.words.astype("<u8").tobytes(), function.before.tobytes(), entries.tobytes()]


def _index_of(data: bytes) -> tuple[PerfectHash, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not an index of keys")
    n, levels = struct.unpack_from("<QQ", data, 8)
    sizes = np.frombuffer(data, "<u8", levels, 24).tolist()
    at, words = 24 + 8 * levels, sum(sizes) // 64
    function = PerfectHash(sizes, np.frombuffer(data, "<u8", words, at), np.frombuffer(data, "<u4", words, at + 8 * words))
    return function, np.frombuffer(data, ENTRY, n, at + 12 * words)


# Writing.

@dataclass(frozen=True)
class Store:
    """A folder with its tables of shards and of parts of the index."""

    folder: str
    width: int
    n_shards: int
    n_parts: int

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/shards")

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/parts")


class _Shard:
    """One file being written."""

    def __init__(self, folder: str, width: int):
        self.name = f"ids-{uuid.uuid4().hex}.bin"
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        self.out, self.width, self.places = system.open_output_stream(f"{path}/{self.name}"), width, [0]

    def add(self, ids: bytes) -> None:
        self.out.write(ids)
        self.places.append(self.places[-1] + len(ids) // self.width)

    def close(self) -> None:
        self.out.write(np.array(self.places, "<u8").tobytes() + struct.pack("<Q", len(self.places) - 1))
        self.out.close()


def _writer(path: str, folder: str, width: int, end_id: int, shard_bytes: int):
    end, kind = end_id.to_bytes(width, "little"), f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]):
        task, roll, shard = TaskContext.get().partitionId(), 0, None
        for part, encoded in encoded_batches(batches, path, 1):
            rows = []
            for ids in encoded:
                if shard is not None and (shard.places[-1] * width >= shard_bytes or len(shard.places) > SHARD_DOCS):
                    shard.close()
                    shard, roll = None, roll + 1
                if shard is None:
                    shard = _Shard(folder, width)
                shard.add((ids if width == 4 else np.frombuffer(ids, "<u4").astype(kind).tobytes()) + end)
                rows.append((task, roll, len(shard.places) - 2, shard.places[-2], shard.places[-1] - shard.places[-2], shard.name))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["key", "task", "roll", "record", "offset", "n_tokens", "file"])
        if shard is not None:
            shard.close()
    return run


def _part_of(key: Column, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n_parts)).cast("int")


def _indexer(folder: str):
    def run(group: pa.Table) -> pa.Table:
        a, b = hashes(group.column("key").to_pylist())
        function = PerfectHash.build(a, b)
        entries = np.zeros(len(group), ENTRY)
        at = function.find(a, b)
        entries["print"][at] = b
        for name in ENTRY.names[1:]:
            entries[name][at] = group.column(name).to_numpy()
        name = f"keys-{uuid.uuid4().hex}.idx"
        system, path = filesystem(folder)
        with system.open_output_stream(f"{path}/{name}") as out:
            for block in _index_bytes(function, entries):
                out.write(block)
        return pa.table({"part": group.column("part")[:1], "file": pa.array([name]), "n_keys": pa.array([len(group)], pa.int64())})
    return run


def write(df: DataFrame, path: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS, partitions: int | None = None) -> Store:
    """Encode every whole text with the tokenizer file at `path` and store the ids under their key."""
    width = 2 if max(len(vocabulary(path).tokens) - 1, end_id) < 1 << 16 else 4
    rows = df.select(F.col(id_col).alias("key"), text_of(text_col).alias("text"))
    dealt = rows.withColumn("salt", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ["key", "salt", "place"]
    dealt = dealt.repartitionByRange(partitions or max(1, rows.rdd.getNumPartitions()), *order).sortWithinPartitions(*order).select("key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    documents = written(dealt.mapInArrow(
        _writer(path, folder, width, end_id, shard_bytes), f"key {kind}, task int, roll int, record long, offset long, n_tokens long, file string"), "ids")

    # One row for each shard: their number is bytes / shard_bytes, so one task may number them.
    files = documents.groupBy("task", "roll", "file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    order = Window.orderBy("task", "roll")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    files.select(
        "task", "roll", "file", "n_docs", "n_ids", (F.row_number().over(order) - 1).alias("shard"),
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id")).write.parquet(f"{folder}/shards")
    spark = df.sparkSession
    shards = spark.read.parquet(f"{folder}/shards").select("task", "roll", "shard")

    first, last = F.min(F.struct("shard", "record", "offset")).alias("first"), F.max(F.struct("shard", "record")).alias("last")
    keys = written(documents.join(shards, ["task", "roll"]).groupBy("key").agg(first, last), "keys")
    n_parts = max(1, math.ceil(keys.count() / part_keys))
    parted = keys.select(
        _part_of(F.col("key"), n_parts).alias("part"), "key", "first.*", F.col("last.shard").alias("last_shard"), F.col("last.record").alias("last_record"))
    built = parted.groupBy("part").applyInArrow(_indexer(folder), "part int, file string, n_keys long")
    built.write.parquet(f"{folder}/parts")
    return Store(folder, width, shards.count(), n_parts)


# Reading.

@functools.lru_cache(maxsize=2)
def _loaded(folder: str, name: str) -> tuple[PerfectHash, np.ndarray]:
    system, path = filesystem(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return _index_of(f.readall())


def _finder(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column("file").dictionary_encode()
            for i, name in enumerate(names.dictionary.to_pylist()):
                some = batch.filter(pc.equal(names.indices, i))
                function, entries = _loaded(folder, name)
                a, b = hashes(some.column("key").to_pylist())
                at = function.find(a, b)
                known = at >= 0
                known[known] = entries["print"][at[known]] == b[known]
                hit = entries[at[known]]
                yield pa.RecordBatch.from_arrays(
                    [some.column("key").filter(pa.array(known)), *(pa.array(hit[c].astype(np.int64)) for c in ENTRY.names[1:])], ["key", *ENTRY.names[1:]])
    return run


def locate(store: Store, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Places of the distinct keys that the store holds: shard, record, ids before it in the shard, last shard and record of the key."""
    wanted = keys.select(F.col(id_col).alias("key")).distinct().withColumn("part", _part_of(F.col("key"), store.n_parts))
    kind = wanted.schema["key"].dataType.simpleString()
    named = wanted.join(store.parts(keys.sparkSession).select("part", "file"), "part").repartition("part").sortWithinPartitions("part")
    return named.select("key", "file").mapInArrow(
        _finder(store.folder), f"key {kind}, " + ", ".join(f"{c} long" for c in ENTRY.names[1:]))


def _places(f, width: int) -> np.ndarray:
    size = f.size()
    f.seek(size - 8)
    n = struct.unpack("<Q", f.read(8))[0]
    f.seek(size - 8 - 8 * (n + 1))
    return np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)


def _reader(folder: str, width: int):
    system, path = filesystem(folder)

    def span(f, places, wanted):
        """Ids of (row, record) pairs that follow each other in the file, read at once."""
        first = places[wanted[0][1]]
        f.seek(int(first) * width)
        block = np.frombuffer(f.read(int(places[wanted[-1][1] + 1] - first) * width), f"<u{width}").astype("<u4")
        return [(row, record, block[places[record] - first:places[record + 1] - first].tobytes()) for row, record in wanted]

    def spans(f, places, pairs):
        wanted = []
        for row, record in pairs:
            if wanted and (record - wanted[-1][1] not in (0, 1) or (places[record + 1] - places[wanted[0][1]]) * width > SPAN_BYTES):
                yield span(f, places, wanted)
                wanted = []
            wanted.append((row, record))
        if wanted:
            yield span(f, places, wanted)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            files, start, end, first = (batch.column(c).to_pylist() for c in ("file", "from_record", "to_record", "first_id"))
            at = 0
            while at < len(files):
                stop = at
                while stop < len(files) and files[stop] == files[at]:
                    stop += 1
                with system.open_input_file(f"{path}/{files[at]}") as f:
                    places = _places(f, width)
                    last = len(places) - 2
                    pairs = ((row, r) for row in range(at, stop) for r in range(start[row], (last if end[row] is None else end[row]) + 1))
                    for block in spans(f, places, pairs):
                        rows, records, ids = zip(*block)
                        n = [len(b) // 4 for b in ids]
                        yield pa.RecordBatch.from_arrays([
                            batch.column("key").take(pa.array(rows, pa.int32())), pa.array([first[at] + int(places[r]) for r in records], pa.int64()),
                            pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_tokens", "ids"])
                at = stop
    return run


def read(store: Store, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All documents under the keys: key, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    found = locate(store, keys, id_col)
    kind = found.schema["key"].dataType.simpleString()
    # A key whose rows go on in later shards is one request a shard; null stands for the shard's last record.
    requests = found.select("*", F.explode(F.sequence("shard", "last_shard")).alias("at")).select(
        "key", F.col("at").alias("shard"), F.when(F.col("at") == F.col("shard"), F.col("record")).otherwise(0).alias("from_record"),
        F.when(F.col("at") == F.col("last_shard"), F.col("last_record")).alias("to_record"))
    files = store.shards(keys.sparkSession).select(F.col("shard").cast("long").alias("shard"), "file", "first_id")
    # The requests are small, the ids behind them are not: a task for each shard, whatever the size of its requests.
    tasks = max(1, min(store.n_shards, READERS))
    named = requests.join(files, "shard").repartition(tasks, "shard").sortWithinPartitions("shard", "from_record")
    return named.select("key", "file", "from_record", "to_record", "first_id").mapInArrow(
        _reader(store.folder, store.width), f"key {kind}, start long, n_tokens long, ids binary")


def get(store: Store, spark: SparkSession, key) -> list[np.ndarray]:
    """The ids of each document under one key, by direct access."""
    sample = spark.createDataFrame([(None if key is None else str(key),)], "key string")
    part = sample.select(_part_of(F.col("key"), store.n_parts).alias("p")).first()["p"]
    named = store.parts(spark).where(F.col("part") == part).first()
    if named is None:
        return []
    function, entries = _loaded(store.folder, named["file"])
    a, b = hashes([key])
    at = int(function.find(a, b)[0])
    if at < 0 or entries["print"][at] != b[0]:
        return []
    entry, found = entries[at], []
    system, path = filesystem(store.folder)
    for shard in store.shards(spark).where(F.col("shard").between(int(entry["shard"]), int(entry["last_shard"]))).orderBy("shard").toLocalIterator():
        with system.open_input_file(f"{path}/{shard['file']}") as f:
            places = _places(f, store.width)
            start = int(entry["record"]) if shard["shard"] == entry["shard"] else 0
            end = int(entry["last_record"]) if shard["shard"] == entry["last_shard"] else len(places) - 2
            for r in range(start, end + 1):
                f.seek(int(places[r]) * store.width)
                found.append(np.frombuffer(f.read(int(places[r + 1] - places[r]) * store.width), f"<u{store.width}").astype(np.int64))
    return found


def report(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
