"""Near-duplicate groups by one-permutation hashing.

Each text becomes the set of its distinct word shingles. One hash of a shingle
gives both a bin and a value; a bin's least value is one coordinate of the
signature. An empty bin borrows from a bin that a hash of (bin, attempt) picks,
trying again until it meets a filled one (optimal densification). Bands of
coordinates are bucket keys.

Equal sets are one vertex with one representative row. In each bucket the member
that shares most buckets with others is the centre, and the bucket gives only
the edges of a star: centre to member. Edges are confirmed on the full shingle
sets of the two texts. A link between two members that are both unlike their
centre is not lost: the comparison with the centre says how many shingles outside
it they must share, and pairs that do are confirmed as well (see `_across`).

Similar pairs miss all 32 bands with a probability below 1e-5 at the threshold,
and less above it.

Defined results: a text without words (or null) has no shingles and stays alone;
fewer words than a shingle form one shingle of the whole sequence; a repeated row
is linked with its copies; the component's identifier is its smallest non-null
identifier, and a row alone has its own; columns other than identifier and text
are neither read nor returned by `groups`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of, written
from fleetstat.llm.components import components

BANDS = 32
#: Coordinates in a band by least similarity in percent.
ROWS = {85: 7, 80: 5}
_PART = 1 << 20
_SPACES = tuple(bytes([c]) for c in (0x20, *range(0x09, 0x0E)))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    ones = np.ones(_PART + 1, dtype=np.uint64)
    ones[1:] = _BASE
    back = np.ones(_PART + 1, dtype=np.uint64)
    back[1:] = inverse
    return np.cumprod(ones, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _hash_part(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a part that neither begins nor ends inside a word."""
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(raw) > _PART:  # a word longer than a part has a digest; the choice is by its own length
        long = lambda a, b: int.from_bytes(hashlib.blake2b(_LOWER[raw[a:b]].astype(np.uint8).tobytes(), digest_size=8).digest(), "little")
        return starts, np.array([long(a, b) if b - a > _PART else _hash_part(raw[a:b])[1][0] for a, b in zip(starts, ends)], dtype=np.uint64)
    if not _POWERS:
        _POWERS.append(_powers())
    up, down = _POWERS[0]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw] + _U(1)) * up[:len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word, in parts cut at white space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + _PART, len(data))
        if end < len(data) and not _SPACE.match(data, end):
            cut = max(data.rfind(space, at, end) for space in _SPACES)
            if cut > at:
                end = cut
            else:
                found = _SPACE.search(data, end)
                end = found.start() if found else len(data)
        s, h = _hash_part(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at))
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = b"\n".join(texts)
    starts, hashed = word_hashes(data)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    bounds = np.append(np.searchsorted(starts, first), len(starts))
    rolled = np.zeros(max(0, len(hashed) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = mix(rolled * _BASE + hashed[k:k + len(rolled)] + _U(k + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole * _BASE + hashed[k:k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One-permutation signatures of non-empty sets, empty bins filled by optimal densification."""
    sig = np.full((len(sets), size), _FULL, dtype=np.uint64)
    if not sets:
        return sig
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    value = mix(np.concatenate(sets) ^ _BASE)
    bins = ((value >> _U(32)) % _U(size)).astype(np.int64)
    np.minimum.at(sig.reshape(-1), row * size + bins, mix(value))
    filled = sig != _FULL
    doc, empty = np.nonzero(~filled)
    attempt = 0
    while len(doc):
        other = (mix(empty.astype(np.uint64) * _U(size) + _U((1 + attempt) * int(_BASE) % (1 << 64))) % _U(size)).astype(np.int64)
        met = filled[doc, other]
        sig[doc[met], empty[met]] = sig[doc[met], other[met]]
        doc, empty, attempt = doc[~met], empty[~met], attempt + 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sig), bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        key = mix(key * _BASE + parts[:, :, r])
    return key.astype(np.int64)


def _prepared(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """Write every row with its text, set size, set digest and band keys."""
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    schema = base.select("*", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("set_key"), F.lit(None).cast("array<long>").alias("bands")).schema

    def run(batches):
        for batch in batches:
            data = batch.column(2)
            for start, end in slices([len(t.as_buffer()) for t in data], 2 << 20):
                part = batch.slice(start, end - start)
                sets = shingle_sets([t.as_buffer().to_pybytes() for t in part.column(2)], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                lists: list = [None] * len(sets)
                for i, k in zip(full, keys):
                    lists[i] = k
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(lists, pa.list_(pa.int64()))], names)

    names = schema.names
    return written(base.mapInArrow(run, schema), "signatures")


def _compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their full shingle sets, what they share, and the shingles of b that a lacks."""
    side = texts.select(F.col("row"), F.col("text"))
    joined = (pairs.join(side.withColumnRenamed("row", "b").withColumnRenamed("text", "text_b"), "b")
              .join(side.withColumnRenamed("row", "a").withColumnRenamed("text", "text_a"), "a")
              .select("a", "b", "text_a", "text_b"))

    def run(batches):
        known, known_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in slices([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))], 4 << 20):
                others = shingle_sets([t.as_buffer().to_pybytes() for t in batch.column(3).slice(start, end - start)], words)
                sizes, lacking = [], []
                for i, other in zip(range(start, end), others):
                    if a[i] != known:  # the rows of one centre mostly follow each other
                        known, known_set = a[i], shingle_sets([batch.column(2)[i].as_buffer().to_pybytes()], words)[0]
                    sizes.append(len(known_set))
                    lacking.append(np.setdiff1d(other, known_set, assume_unique=True).astype(np.int64))
                n_b = np.array(list(map(len, others)), dtype=np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(list(map(len, lacking))))).astype(np.int32)), pa.array(np.concatenate(lacking)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[start:end]), pa.array(b[start:end]), pa.array(sizes, pa.int64()), pa.array(n_b),
                     pa.array(n_b - np.array(list(map(len, lacking)), dtype=np.int64)), lists], ["a", "b", "n_a", "n_b", "both", "lacking"])

    return joined.mapInArrow(run, "a long, b long, n_a long, n_b long, both long, lacking array<long>")


def _texts_of(prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of all rows in the pairs, by a merge join at every size: the rows named grow with the input."""
    rows = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    return written(prepared.select("row", "text").join(rows.hint("merge"), "row", "left_semi"), "texts")


def _needed(a: str, b: str, percent: int):
    """What sets of these sizes must share at least, times 100 + percent."""
    return F.lit(percent) * (F.col(a) + F.col(b))


def _across(checked: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that may be linked although neither is linked with the centre's side of the other.

    Let c be their centre. What a and b share lies in c, at most the smaller of |a & c|
    and |b & c|, or in both of a - c and b - c. The comparison with c has counted the
    first, so a number t is known that a - c must at least share with any b - c:

    * t > 0: a candidate shares one of a's |a - c| - t + 1 rarest shingles outside c
      (a prefix filter, with rarity counted among the members of c);
    * t <= 0, possible only if c is larger than some member: sizes decide which
      members come into question.

    Members of one component are compared no more. The result holds every pair that
    can reach the similarity, so no link is lost, and copies of one text with edits
    of their own, which share nothing outside it, give no pairs.
    """
    component = found.select("vertex", "component")
    placed = checked.join(component, F.col("b") == F.col("vertex"), "left").select(
        F.col("a").alias("c"), F.col("b").alias("v"), F.col("n_a").alias("n_c"), F.col("n_b").alias("n"), F.col("both").alias("x"), "lacking",
        F.coalesce("component", "b").alias("k"))
    at_centre = component.withColumnRenamed("component", "own")
    placed = placed.join(at_centre, F.col("c") == F.col("vertex"), "left").withColumn("own", F.coalesce("own", "c")).drop("vertex")
    open_ = placed.groupBy("c").agg(
        F.min(F.least("n", "n_c")).alias("low"), F.max((F.col("k") != F.col("own")).cast("int")).alias("apart")).where("apart = 1").select("c", "low")
    least = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    members = written(
        placed.join(open_, "c").withColumn("t", F.ceil(F.lit(percent) * (F.col("n") + least) / (100 + percent)) - F.col("x"))
        .select("c", "v", "n", "x", "k", "lacking", "t"), "members")

    outside = members.where("t <= size(lacking)").select("c", "v", "n", "k", "t", F.explode("lacking").alias("h"))
    shared = outside.groupBy("c", "h").agg(F.count("*").alias("df"), F.min("k").alias("first"), F.max("k").alias("last")).where("df > 1 and first <> last")
    rare = (outside.join(shared.select("c", "h", "df"), ["c", "h"]).groupBy("c", "v", "n", "k", "t")
            .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common")))
    prefix = F.when(F.col("t") > 0, F.slice("common", F.lit(1), F.greatest(F.size("common") - F.col("t") + 1, F.lit(0)).cast("int"))).otherwise(F.col("common"))
    keys = written(rare.select("c", "v", "n", "k", F.explode(prefix).alias("p")).select("c", "v", "n", "k", "p.h"), "prefixes")

    def sides(df, *columns):
        return (df.select("c", *(["h"] if "h" in df.columns else []), *[F.col(x).alias(f"{x}_{s}") for x in ("v", "n", "k", *columns)]) for s in "ab")

    left, right = sides(keys)
    apart = (F.col("v_a") < F.col("v_b")) & (F.col("k_a") != F.col("k_b")) & _near("n_a", "n_b", percent)
    by_shingle = left.join(right, ["c", "h"]).where(apart).select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))
    left, right = sides(members.where("t <= 0"), "x")
    by_size = left.join(right, "c").where(
        apart & ((100 + percent) * F.least("x_a", "x_b") >= _needed("n_a", "n_b", percent))).select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))
    return written(by_shingle.unionByName(by_size).distinct(), "across")


def _near(a: str, b: str, percent: int):
    """Sets of such sizes can be similar enough."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def links(prepared: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Vertex and component for the representatives that are linked with a smaller one."""
    vertices = prepared.join(classes.select(F.col("v").alias("row")), "row", "left_semi").select(F.col("row").alias("v"), F.explode("bands").alias("key"))
    shared = vertices.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(vertices.join(shared, "key"), "buckets")

    degree = members.groupBy("v").agg(F.sum("members").alias("degree"))
    ranked = members.join(degree, "v").select("key", F.struct("degree", "v").alias("centre"))
    centres = ranked.groupBy("key").agg(F.max("centre").alias("centre"))
    stars = written(
        members.join(centres, "key").where(F.col("centre.v") != F.col("v")).select(F.col("centre.v").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    checked = written(_compared(stars, _texts_of(prepared, stars), words), "checked")
    similar = (100 + percent) * F.col("both") >= _needed("n_a", "n_b", percent)
    linked = checked.where(similar).select("a", "b")
    found = components(linked)

    across = _across(checked, found, percent)
    if across.isEmpty():
        return found
    more = written(_compared(across, _texts_of(prepared, across), words).where(similar).select("a", "b"), "linked")
    return found if more.isEmpty() else components(linked.unionByName(more))


def groups(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int | None = None) -> DataFrame:
    """One row per row: row, doc_id, n_shingles, component_id, first (whether it is the first row of its group)."""
    prepared = _prepared(df, id_col, text_col, words, bands, rows or ROWS[percent])
    # A row's order inside its group: smallest identifier, null last, then the first row.
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    sets = prepared.where("n > 0").groupBy("set_key").agg(F.min("row").alias("v"), F.min(rank).alias("least"))
    classes = written(sets, "sets")
    found = links(prepared, classes, words, percent)
    placed = classes.join(found, classes["v"] == found["vertex"], "left").select("set_key", "least", F.coalesce("component", "v").alias("c"))
    least = placed.groupBy("c").agg(F.min("least").alias("head"))
    of_set = placed.join(least, "c").select("set_key", "head")
    narrow = prepared.select("row", "doc_id", "n", "set_key")
    alone = narrow.where("set_key is null").withColumn("head", rank)
    together = narrow.where("set_key is not null").join(of_set, "set_key")
    return together.unionByName(alone).select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"), (F.col("head.row") == F.col("row")).alias("first"))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns."""
    log = written(df.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("number")), "rows")
    # The record's number rides along as part of the identifier, so that the rows that stay can be told by it.
    own = F.col("record").getField(id_col)
    named = log.select(F.struct(own.isNull().alias("no_id"), own.alias("id"), "number").alias("doc_id"), F.col("record").getField(text_col).alias("text"))
    kept = groups(named, words, percent).where("first").select(F.col("doc_id.number").alias("number"))
    return log.join(kept, "number", "left_semi").select("record.*")
