"""Collocations of two to four words, by mining shards and counting their union (SON).

Documents are dealt to a few shards. A phrase that occurs `least` times in a language
occurs, in at least one shard, as often as the shard's share of the language's words
lets expect: `least * words of the shard / words of the language`. Each shard is mined
completely at that lowered support, length by length: a phrase is only counted in a
shard's pass if its words are frequent and all pairs of neighbours in it were locally
frequent in some shard. The union of what is locally frequent holds every frequent
phrase; one more pass counts the union's phrases exactly over all documents.

A shard is not a task: its counts are summed by shard and phrase over all tasks, so a
shard may have any size and their number stays below `least`, where a lowered support
still rules phrases out. Between passes the union travels as a bit table of fixed size
(2^`bits` bits, 8 MB) over hashes of language and phrase. It has no phrase too few;
those it has too many are counted and then fall to the exact support, so hashes never
decide a result: the last pass counts language and words themselves.

A worker reads words of about 4 MB of text at once as numbers of a table of its distinct
words (exact), and phrases as numbers of pairs (shorter phrase, next word). Texts are cut
at the ends of pieces only, so no phrase is lost; memory follows the longest piece.

Scores, cuts and containment are joins of the counted phrases by language and words,
with exact decimal arithmetic. A phrase is contained in longer candidates if the most
frequent of those that hold its words has its share of the occurrences.

Defined results: a null text has no words, a null language is `und`; rows count as often
as they occur; words are case-folded in A-Z only and compared as bytes; a language with
no candidate, and an empty table, give no row; other columns and identifiers are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of, written

LEAST, LONGEST, TOP = 30, 4, 2000
HELD_PERCENT = 80
SCALE = 2_000_000
SHARDS = 3
BITS = 26
#: Values of the hash of language and shard, the low 16 bits of a key.
CELLS = 1 << 16
#: Bytes of text a worker reads at once.
SLICE_BYTES = 4 << 20

# Classes of bytes: part of a word, blank, end of a piece.
_WORD, _BLANK, _END = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of a hash that travel in a key; bit tables look at fewer.
_KEPT = np.uint64((1 << 40) - 1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    x = (x ^ (x >> np.uint64(29))) * _C1
    return x ^ (x >> np.uint64(32))


def _hash_of(values: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values], dtype=np.uint64)


def _first_hash(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(lang * _C1 ^ word)


class Words:
    """The words of some texts: number and piece of each, and the distinct words."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """`data`: bytes of the texts, each followed by an end of a piece; `ends`: where each text ends."""
        data = _LOWER[data]
        kinds = _CLASS[data]
        inside = kinds == _WORD
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = stops - starts
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(kinds == _END, dtype=np.int32)[starts]
        self.text = np.searchsorted(ends, starts, side="right")


def _factorized(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each code and the first place of each number."""
    numbers, unique = pd.factorize(codes)
    first = np.empty(len(unique), np.int64)
    first[numbers[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return numbers, first


class Phrases:
    """Phrases of one length at the places where they start, with one hash for each distinct one."""

    def __init__(self, words: Words, group: np.ndarray, group_hash: np.ndarray, word_hash: np.ndarray):
        """Length one: `group` is the group (language) of each text."""
        self.words, self.word_hash, self.length = words, word_hash, 1
        at = group[words.text]
        self.place = np.arange(len(words.number))
        self.number, self.first = _factorized(at * max(1, len(words.distinct)) + words.number)
        self.group = at[self.first]
        self.hash = _first_hash(group_hash[self.group], word_hash[words.number[self.first]])

    def allowed(self, table: np.ndarray | None) -> np.ndarray:
        """For each distinct phrase, whether it is in the table."""
        if table is None:
            return np.ones(len(self.first), bool)
        at = self.hash & np.uint64(8 * len(table) - 1)
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def longer(self, table: np.ndarray | None) -> Phrases:
        """Phrases one word longer, of which both shorter phrases are in the table."""
        words, n = self.words, self.length
        known = np.zeros(len(words.number) + 1, bool)
        known[self.place] = self.allowed(table)[self.number]
        place = self.place[known[self.place] & known[self.place + 1]]
        place = place[place + n < len(words.number)]
        place = place[words.piece[place] == words.piece[place + n]]
        number = np.zeros(len(words.number), np.int64)
        number[self.place] = self.number
        made = object.__new__(Phrases)
        made.words, made.word_hash, made.length, made.place = words, self.word_hash, n + 1, place
        last = words.number[place + n]
        made.number, made.first = _factorized(number[place] * max(1, len(words.distinct)) + last)
        shorter = number[place[made.first]]
        made.group = self.group[shorter]
        made.hash = _mix(self.hash[shorter] * _C1 ^ self.word_hash[last[made.first]] + np.uint64(n))
        return made

    def counts(self) -> np.ndarray:
        return np.bincount(self.number, minlength=len(self.first))

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words of distinct phrases, joined by a space."""
        starts = self.place[self.first[which]]
        joined = [self.words.distinct.take(pa.array(self.words.number[starts + i])).cast(pa.binary()) for i in range(self.length)]
        return pc.binary_join_element_wise(*joined, pa.scalar(b" ", pa.binary())).cast(pa.string())


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts, each closed by an end of a piece, in stretches of about SLICE_BYTES that close with one too, and where each text ends."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if len(data) <= 2 * SLICE_BYTES:
        yield data, ends
        return
    closes = np.flatnonzero(_CLASS[data] == _END) + 1
    start = 0
    while start < len(data):
        at = max(np.searchsorted(closes, start + SLICE_BYTES, side="right") - 1, np.searchsorted(closes, start, side="right"))
        stop = int(closes[at])
        yield data[start:stop], ends - start
        start = stop


def _chains(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray | None]) -> Iterator[tuple[list[tuple], list[Phrases]]]:
    """Phrases of one word, two words and so on in each slice of rows (lang, ..., text); groups are the values before the text."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        for start, end in slices([len(t) if (t := s.as_buffer()) is not None else 0 for s in texts], SLICE_BYTES):
            values = list(zip(*(batch.column(i).slice(start, end - start).to_pylist() for i in range(batch.num_columns - 1))))
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(v, len(names)) for v in values])
            lang_hash = _hash_of([v[0].encode() for v in names])
            for data, ends in _segments(texts.slice(start, end - start).to_pylist()):
                words = Words(data, ends)
                if not len(words.number):
                    continue
                chain = [Phrases(words, group, lang_hash, _hash_of(words.distinct.to_pylist()))]
                for table in tables:
                    chain.append(chain[-1].longer(table))
                yield list(names), chain


# The passes.

def documents_of(df: DataFrame, text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS) -> DataFrame:
    """lang, cell and text of every document. Its file decides a document's shard (its text, where it comes from no file),
    so every pass deals alike and a task's documents mostly share one. A cell is a hash of language and shard."""
    text = text_of(text_col)
    shard = F.pmod(F.when(F.input_file_name() != "", F.xxhash64(F.input_file_name())).otherwise(F.xxhash64(text)), F.lit(shards))
    dealt = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"), text.alias("text"))
    return dealt.select("lang", F.pmod(F.xxhash64("lang", "shard"), F.lit(CELLS)).cast("int").alias("cell"), "text")


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, n of the frequent words of each language, and lang, cell, n (word null) of all words of each shard."""
    def run(batches):
        for names, (one,) in _chains(batches, []):
            langs, cells = zip(*names)
            counts, n = one.counts(), len(names)
            here = np.bincount(one.group, weights=counts, minlength=n).astype(np.int64)
            group = pa.array(np.concatenate([one.group, np.arange(n)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()).take(group), pa.concat_arrays([pa.nulls(len(counts), pa.int32()), pa.array(cells, pa.int32())]),
                pa.concat_arrays([one.texts(np.arange(len(counts))), pa.nulls(n, pa.string())]),
                pa.array(np.concatenate([counts, here]))], ["lang", "cell", "word", "n"])
    rows = docs.select("lang", "cell", "text").mapInArrow(run, "lang string, cell int, word string, n long")
    return written(rows.groupBy("lang", "cell", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()), "words")


def supports(sizes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The words of each language, and the support that its share of them leaves to each cell (the least of any it stands for)."""
    total = sizes.groupBy("lang").agg(F.sum("n").alias("total"))
    needed = F.expr(f"cast(cast({least} * cast(n AS decimal(20, 0)) + total - 1 AS decimal(38, 0)) div total AS long)")
    return total, written(sizes.join(total, "lang").groupBy("cell").agg(F.min(needed).alias("needed")), "supports")


def word_hashes(words: DataFrame) -> DataFrame:
    """The hashes that passes look for single words by."""
    def run(batches):
        for batch in batches:
            lang, word = (_hash_of([v.encode() for v in batch.column(i).to_pylist()]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_first_hash(lang, word).view(np.int64))], ["hash"])
    return words.select("lang", "word").mapInArrow(run, "hash long")


def shard_phrases(docs: DataFrame, needed: DataFrame, tables: list[Broadcast], lengths: tuple[int, ...]) -> DataFrame:
    """Hashes of the phrases of these lengths that are locally frequent in some shard."""
    def run(batches):
        chain = [t.value for t in tables]
        for names, phrases in _chains(batches, chain + [None] * (max(lengths) - 1 - len(chain))):
            cells = np.array([n[1] for n in names], np.uint64)
            for p in phrases:
                if p.length in lengths and len(p.first):
                    key = ((p.hash & _KEPT) << np.uint64(16)) | cells[p.group]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(p.counts())], ["key", "n"])
    rows = docs.select("lang", "cell", "text").mapInArrow(run, "key long, n long")
    local = rows.groupBy("key").agg(F.sum("n").alias("n")).withColumn("cell", F.col("key").bitwiseAND(F.lit(CELLS - 1)).cast("int"))
    # At most CELLS short rows are broadcast.
    return local.join(F.broadcast(needed), "cell").where("n >= needed").select(F.shiftrightunsigned("key", 16).alias("hash"))


def bit_table(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """The union as a table of 2^bits bits: at most 2^(bits - 6) words of it reach the driver, 8 MB with 26 bits, whatever the union."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def counted(docs: DataFrame, tables: list[Broadcast], least: int, longest: int) -> DataFrame:
    """Exact counts of the union's phrases of two words and more, those of at least `least`: lang, phrase, a."""
    def run(batches):
        bits = [t.value for t in tables]
        for names, phrases in _chains(batches, bits[:longest - 1]):
            langs = pa.array([n[0] for n in names], pa.string())
            for p, allowed in zip(phrases[1:], bits[1:]):
                which = np.flatnonzero(p.allowed(allowed))
                if len(which):
                    yield pa.RecordBatch.from_arrays([
                        langs.take(pa.array(p.group[which])), p.texts(which), pa.array(p.counts()[which])], ["lang", "phrase", "n"])
    rows = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame) -> DataFrame:
    """Each candidate with the cut of the lowest score."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = phrases.where("length > 1").select("lang", "phrase", "length", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - length)").alias("rest"))
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"cast({SCALE} AS decimal(8, 0)) * cast(a AS decimal(20, 0)) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    lowest = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score.cast("long"))
    return lowest.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "length", "a", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """For each phrase inside longer candidates the count of the most frequent of them: lang, phrase, longer."""
    words = phrases.where("length > 2").select("lang", "length", "a", F.split("phrase", " ").alias("w"))
    spans = F.expr("flatten(transform(sequence(2, length - 1), n -> transform(sequence(1, length - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    return words.select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(df: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, held_percent: int = HELD_PERCENT, shards: int = SHARDS,
                 bits: int = BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    if shards < 1 or longest < 2:
        raise ValueError("at least one shard, phrases of at least two words")
    docs = documents_of(df, text_col, lang_col, shards)
    # Words are counted exactly at once, so only frequent ones go on.
    words = word_counts(docs, least)
    total, needed = supports(words.where("word IS NULL AND n > 0").select("lang", "cell", "n"), least)
    single = words.where("word IS NOT NULL")
    tables = [bit_table(word_hashes(single), bits)]
    tables.append(bit_table(shard_phrases(docs, needed, tables, (2,)), bits))
    if longest > 2:
        # All greater lengths in one pass: phrases whose pairs of neighbours are all in the table.
        longer = bit_table(shard_phrases(docs, needed, tables, tuple(range(3, longest + 1))), bits)
        tables += [longer] * (longest - 2)
    frequent = counted(docs, tables, least, longest).unionByName(single.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    phrases = written(frequent.withColumn("length", F.size(F.split("phrase", " "))), "phrases")
    held = F.coalesce(100 * F.col("longer").cast("decimal(20,0)") >= held_percent * F.col("a").cast("decimal(20,0)"), F.lit(False))
    kept = scored(phrases).join(contained(phrases), ["lang", "phrase"], "left").where(~held)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(total.withColumnRenamed("total", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
