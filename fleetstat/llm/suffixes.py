"""Removal of repeated byte windows, by most-significant-digit passes over suffixes.

Only the first `window` bytes of a suffix matter, so suffixes are ordered no
further: each pass deals them by one more digit of that key, drops those that are
alone, and the groups that are left after the last pass are the repeated windows.

The first digit is chosen by the content: of all `gram`-byte strings inside the
window, the one with the least hash (the leftmost of equals), with its place in
the window. Equal windows have equal first digits, and neighbouring windows share
theirs, so one row stands for a run of suffixes:

1. An anchor is a place in a text with the run of windows whose least string it
   is. Anchors are dealt by their `gram` bytes; a string met once ends its run.
2. The second digit is the whole extent of the run, all bytes of all its windows.
   Runs with equal extents repeat each other in every window: one row decides
   hundreds of suffixes. Copies and the inside of shared passages end here.
3. The rest are runs that share their first digit and differ in extent, which is
   where passages begin and end. One run of each extent is read again and its
   windows are compared by their place in the run and all their bytes: inside
   one task for a first digit with few extents, else by passes over ever shorter
   pieces of runs, which most runs leave long before their single windows.

Digits travel as hashes: 64 bits of the first digit, 128 of an extent, and 64 of a
window beside those of its first digit and its place. Rows of one key are counted inside each task
before they are shuffled, so a passage in a third of all texts is as even as any.

Defined results: a null text is empty, and texts shorter than the window lose
nothing; a repeated row is text that also starts elsewhere, so it loses all its
windows; columns other than identifier and text are neither read nor returned;
an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of, written

WINDOW = 400
GRAM = 64
#: First digits with at most so many extents are finished inside one task, others window by window.
TOGETHER = 128
#: Places of a run that one piece has in the passes over digits with more extents.
STEPS = (49, 7, 1)
#: Bytes whose windows are looked at together.
_PART = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place, from running sums of powers modulo 2**64."""
    n = len(raw)
    up, down = np.ones(n + 1, dtype=np.uint64), np.ones(n + 1, dtype=np.uint64)
    up[1:], down[1:] = _U(_BASE), _U(pow(_BASE, -1, 1 << 64))
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])


def _least_places(values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each run of `width` values, the place of the least, the leftmost of equals. The last `bits` bits do not count."""
    n = len(values)
    keyed = (values >> _U(bits) << _U(bits)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, _U(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    return (least & _U((1 << bits) - 1)).astype(np.int64)


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text: place, first and last window start of the run."""
    places, firsts, lasts = [], [], []
    width, at, total = window - gram + 1, 0, len(data) - window + 1
    # The bits that give way to the place are as many in every part of every text, so equal windows choose alike.
    # Runs that a part's end cuts are joined again below.
    bits = (_PART + window).bit_length()
    while at < total:
        end = min(at + _PART, total)
        raw = data[at:end + window - 1]
        least = _least_places(_gram_hashes(raw, gram), width, bits)
        change = np.flatnonzero(np.diff(least)) + 1
        first = np.concatenate(([0], change))
        places.append(least[first] + at)
        firsts.append(first + at)
        lasts.append(np.concatenate((change - 1, [len(least) - 1])) + at)
        at = end
    if not places:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    place, first, last = map(np.concatenate, (places, firsts, lasts))
    new = np.concatenate(([True], place[1:] != place[:-1]))
    return place[new], first[new], last[np.concatenate((new[1:], [True]))]


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _anchor_rows(base: DataFrame, window: int, gram: int) -> DataFrame:
    names = ["row", "place", "first", "last", "g", "e1", "e2"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            grams, extents = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer()
                if len(raw) < window:
                    continue
                view = memoryview(raw)
                place, first, last = anchors(np.frombuffer(raw, dtype=np.uint8), window, gram)
                for column, values in zip(out, (np.full(len(place), row), place, first, last)):
                    column.append(values)
                for p, a, b in zip(place.tolist(), first.tolist(), last.tolist()):
                    grams.append(xxhash.xxh3_64_intdigest(view[p:p + gram]))
                    # The run's reach on both sides is part of the digit.
                    extents.append(xxhash.xxh3_128_digest(view[a:b + window], seed=p - a))
            if not grams:
                continue
            high, low = _halves(extents)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate(c)) for c in out), pa.array(np.array(grams, dtype=np.uint64).astype(np.int64)), high, low], names)

    return base.mapInArrow(run, "row long, place long, first long, last long, g long, e1 long, e2 long")


def _extent_rows(wanted: DataFrame, base: DataFrame, window: int) -> DataFrame:
    """One row for each wanted run: first digit, extent, places of the anchor in its first and last window, and all its bytes."""
    runs = wanted.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "first", "last", "g", "e1", "e2", "kinds"))).alias("runs"))
    joined = base.join(runs, "row").select("text", "runs")
    names = ["g", "e1", "e2", "kinds", "high", "low", "body"]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text, listed in zip(batch.column(0), batch.column(1)):
                view = memoryview(text.as_buffer())
                for r in listed.as_py():
                    rows.append((r["g"], r["e1"], r["e2"], r["kinds"], r["place"] - r["first"], r["place"] - r["last"], view[r["first"]:r["last"] + window].tobytes()))
                    if len(rows) == 4096:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    def packed(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names)

    return joined.mapInArrow(run, "g long, e1 long, e2 long, kinds long, high long, low long, body binary")


_BACKS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _ranges(backs: list[int]) -> list[dict]:
    """Runs of consecutive places."""
    out: list[dict] = []
    for b in sorted(backs):
        if out and b == out[-1]["high"] + 1:
            out[-1]["high"] = b
        else:
            out.append({"low": b, "high": b})
    return out


def _together(extents: DataFrame, window: int) -> DataFrame:
    """The repeated windows of first digits with few extents: the last pass, inside a task, one digit after the other."""
    def passed(group: list[tuple]) -> list[tuple]:
        first: dict = {}
        repeated: list[set] = [set() for _ in group]
        for i, (_, _, _, high, body) in enumerate(group):
            view = memoryview(body)
            for s in range(len(body) - window + 1):
                key = (high - s, xxhash.xxh3_64_intdigest(view[s:s + window]))
                other = first.setdefault(key, i)
                if other != i:
                    repeated[other].add(high - s)
                    repeated[i].add(high - s)
        return [(g, e1, e2, _ranges(r)) for (g, e1, e2, _, _), r in zip(group, repeated) if r]

    def packed(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], _BACKS)], ["g", "e1", "e2", "backs"])

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if group and row[0] != group[0][0]:
                    done += passed(group)
                    group = []
                group.append(row)
            if done:
                yield packed(done)
        if group and (done := passed(group)):
            yield packed(done)

    dealt = extents.select("g", "e1", "e2", "high", "body").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "g long, e1 long, e2 long, backs array<struct<low:bigint,high:bigint>>")


def _split(extents: DataFrame, window: int, step: int) -> DataFrame:
    """Cut ranges of places into blocks of `step`: for each piece the bytes common to all windows of the block, and all bytes of the piece."""
    names = ["g", "e1", "e2", "low", "high", "core", "whole"]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for g, e1, e2, top, body, ranges in zip(*(batch.column(k).to_pylist() for k in range(6))):
                view = memoryview(body)
                for r in ranges:
                    for block in range(r["low"] // step * step, r["high"] + 1, step):
                        low, high = max(block, r["low"]), min(block + step - 1, r["high"])
                        # The least place of a block starts last and its greatest ends first.
                        core = xxhash.xxh3_64_intdigest(view[top - block:max(top - block, top - block - step + 1 + window)])
                        out.append((g, e1, e2, low, high, core, xxhash.xxh3_64_intdigest(view[top - high:top - low + window])))
            if out:
                columns = [np.array(c, dtype=np.uint64 if k > 4 else np.int64).astype(np.int64) for k, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

    return extents.mapInArrow(run, "g long, e1 long, e2 long, low long, high long, core long, whole long")


def _apart(extents: DataFrame, window: int) -> DataFrame:
    """The same for first digits with many extents, by more passes, so that no task gets a whole digit.

    A pass cuts the places of a run into blocks. Pieces with the same place and
    bytes repeat each other in all their windows. A piece whose block's common
    bytes are met once cannot repeat. What is left is cut finer, down to single
    windows; of equal pieces one goes on, for others to be compared with.

    A passage in many texts gives one key most pieces. What is counted of a key is
    written before pieces are joined to it: both sides of a join are then plain
    shuffles, of which Spark splits those partitions that are too large.
    """
    keys = ["g", "e1", "e2"]
    bodies = extents.select(*keys, F.col("high").alias("top"), "body")
    todo = extents.select(*keys, F.col("high").alias("top"), "body", F.array(F.struct("low", "high")).alias("ranges"))
    own, found = F.xxhash64("e1", "e2"), []
    for step in STEPS:
        pieces = written(_split(todo, window, step).withColumn("own", own).withColumn("block", F.floor(F.col("low") / step)), "pieces")
        met = written(
            pieces.groupBy("g", "block", "core").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("g", "block", "core"), "met")
        equal = written(pieces.groupBy("g", "low", "high", "whole").agg(F.min("own").alias("first"), F.max("own").alias("last")), "equal")
        alive = written(
            pieces.join(met, ["g", "block", "core"], "left_semi").join(equal, ["g", "low", "high", "whole"])
            .withColumn("decided", F.col("first") != F.col("last")), "alive")
        found.append(alive.where("decided").select(*keys, "low", "high"))
        if step > 1:
            left = written(alive.groupBy("g", "block", "core").agg(F.bool_and("decided").alias("all")).where("not all").select("g", "block", "core"), "left")
            on = alive.where("own = first").join(left, ["g", "block", "core"], "left_semi")
            ranges = on.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"))
            todo = bodies.join(ranges, keys)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys).agg(F.collect_list(F.struct("low", "high")).alias("backs"))


def repeated(base: DataFrame, window: int, gram: int) -> DataFrame:
    """For each row with repeats: (row, spans), spans being (start, end) of bytes covered by repeated windows."""
    found = written(_anchor_rows(base, window, gram), "anchors")
    own = F.struct("row", "place", "first", "last")
    extents = found.groupBy("g", "e1", "e2").agg(F.count("*").alias("n"), F.min(own).alias("sample"))
    extents = written(extents, "extents")
    strings = written(extents.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("n").alias("runs"), F.min("n").alias("least")).where("runs > 1"), "strings")
    alive = written(extents.join(strings, "g").select("g", "e1", "e2", "n", "kinds", "least", "sample"), "alive")

    # Extents met twice are decided. The others need their windows, and so does whatever they are compared with.
    wanted = alive.where("kinds > 1 and least = 1").select("g", "e1", "e2", "kinds", "sample.*")
    bodies = written(_extent_rows(wanted, base, window), "bodies")
    few, many = F.col("kinds") <= TOGETHER, F.col("kinds") > TOGETHER
    single = _together(bodies.where(few), window).unionByName(_apart(bodies.where(many), window))

    decided = alive.where("n > 1").select("g", "e1", "e2", F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("backs"))
    marks = decided.unionByName(single.join(decided.select("g", "e1", "e2"), ["g", "e1", "e2"], "left_anti"))
    # One span for a decided run, else one for each range of its windows that repeats; the last step unites them.
    spans = found.join(marks, ["g", "e1", "e2"]).select("row", F.when(
        F.col("backs").isNull(), F.array(F.struct(F.col("first").alias("start"), (F.col("last") + window).alias("end")))
    ).otherwise(F.transform("backs", lambda b: F.struct((F.col("place") - b["high"]).alias("start"), (F.col("place") - b["low"] + window).alias("end")))).alias("spans"))
    return spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, removed (the spans taken out), kept (the remaining bytes)."""
    if not 0 < gram <= window:
        raise ValueError("the string of the first digit must lie inside the window")
    base = written(df.select(
        F.monotonically_increasing_id().alias("row"), text_of(text_col).cast("binary").alias("text"), F.col(id_col).alias("doc_id")), "texts")
    spans = repeated(base.select("row", "text"), window, gram)
    joined = base.join(spans, "row", "left").select("doc_id", "text", "spans")
    schema = joined.select(
        "doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.col("text").alias("kept")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for start, end in slices([len(t.as_buffer()) for t in batch.column(1)]):
                part = batch.slice(start, end - start)
                removed, kept, sizes = [], [], []
                for text, listed in zip(part.column(1), part.column(2).to_pylist()):
                    raw, cuts = text.as_buffer().to_pybytes(), _united(listed or [])
                    edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append([{"start": a, "end": b} for a, b in cuts])
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, schema)


def report(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"), (F.size("removed") > 0).alias("repeated"))
