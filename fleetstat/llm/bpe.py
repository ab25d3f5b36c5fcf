"""Byte-pair encoding and decoding with segment trees over adjacent pair ranks.

Words are merged by a segment tree whose leaves are the adjacent pairs of a word
(rank, place); the root is the leftmost pair of the lowest rank. A merge changes
at most three leaves, each updated along one path to the root; merging ends when
the root holds no mergeable pair. Short words of a batch are merged together,
one array row for each tree; long words have a tree of their own.

The vocabulary is a tokenizer file with word ends (`</w>`), NFC, white space
collapsed, lower case and byte-level symbols. Special tokens written out in a
text become their ids, as in the public library. Each distinct chunk of a text
between white space is encoded once for each worker process and kept in a table
of bounded size.

Defined results: a null or blank text has no ids and decodes to the empty text;
repeated rows give repeated results; columns besides the identifier and the text
are neither read nor returned; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of

END = "</w>"
NONE = np.int64(1) << 60
#: Words of more symbols get a tree of their own.
LONG = 64
#: Chunks and words a worker keeps. A full table of chunks keeps those of the texts at hand, a full table of words is emptied.
KEPT_CHUNKS, KEPT_WORDS = 600_000, 400_000
#: Symbols of the words that are merged together: few enough for a processor's cache.
_PLACES = 1 << 17
#: Ids from 0 on whose pairs have a table of their own.
FIRST = 512
#: Chunks whose ids are put in place together.
_PART = 1 << 17

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = regex.compile(f"[^{_SPACE}]+")
#: Characters that str.split() takes for white space, but Unicode does not.
_ODD = regex.compile("[\x1c-\x1f]")
# Fixed value: the pattern that splits normalised text into words.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*ids.values(), *self.special.values()]) + 1, dtype=object)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.byte_id = np.array([ids[s] for s in symbols], dtype=np.int64)
        self.end_id = np.array([ids[s + END] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.shift = int(len(self.tokens)).bit_length()
        keys = np.array([(ids[a] << self.shift) | ids[b] for a, b in pairs], dtype=np.int64)
        self.kind = np.uint32 if 2 * self.shift <= 32 else np.int64
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order].astype(self.kind), order.astype(np.int32)
        # Ranks of the pairs of bytes, which the first ids of the file stand for.
        first = np.arange(min(FIRST, len(self.tokens)))
        self.near = self.ranks(*(x.ravel() for x in np.meshgrid(first, first, indexing="ij"))).reshape(len(first), -1)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or -1."""
        key = (left.astype(self.kind) << self.kind(self.shift)) | right.astype(self.kind)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], np.int32(-1))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_together(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at most `symbols.shape[1]` symbols, one segment tree in each row of an array; all ids, and how many each word has."""
    n_words, width = symbols.shape
    leaves = 1
    while leaves < width:
        leaves *= 2
    place = leaves.bit_length()
    mask = (1 << place) - 1
    symbols, none = symbols.astype(np.int32), np.int32(1 << 30)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n_words, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n_words, 1))
    tree = np.full((n_words, 2 * leaves), none)

    def leaf(rows, at, follow):
        """Value of the pair that starts at `at`, if `follow` is inside the word."""
        inside = follow < lengths[rows]
        rank = v.ranks(symbols[rows, at], symbols[rows, np.minimum(follow, width - 1)])
        return np.where(inside & (rank >= 0), (rank << place) | at, none)

    left, right = symbols[:, :-1], symbols[:, 1:]
    rank = v.near[left, right] if symbols.max(initial=0) < len(v.near) else v.ranks(left.ravel(), right.ravel()).reshape(left.shape)
    at = np.arange(width - 1, dtype=np.int32)
    tree[:, leaves:leaves + width - 1] = np.where((at + 1 < lengths[:, None]) & (rank >= 0), (rank << place) | at, none)
    level = leaves
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half

    def update(rows, at, value):
        node = leaves + at
        tree[rows, node] = value
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        root = tree[rows, 1]
        at, rank = root & mask, root >> place
        gone = after[rows, at]
        follow = after[rows, gone]
        symbols[rows, at] = v.made[rank]
        after[rows, at] = follow
        symbols[rows, gone] = -1
        linked = follow < lengths[rows]
        before[rows[linked], follow[linked]] = at[linked]
        update(rows, gone, none)
        update(rows, at, leaf(rows, at, follow))
        prior = before[rows, at]
        some = prior >= 0
        if some.any():
            update(rows[some], prior[some], leaf(rows[some], prior[some], at[some]))
        rows = rows[tree[rows, 1] < none]
    alive = (symbols >= 0) & (np.arange(width) < lengths[:, None])
    return symbols[alive], alive.sum(axis=1)


def merge_alone(v: Vocabulary, symbols: list[int]) -> np.ndarray:
    """Merge one long word with a segment tree in plain lists."""
    n, none = len(symbols), int(NONE)
    leaves = 1
    while leaves < n:
        leaves *= 2
    place = leaves.bit_length()
    mask = (1 << place) - 1
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * leaves)

    def leaf(at, follow):
        if follow >= n:
            return none
        rank = v.rank_of.get((symbols[at] << v.shift) | symbols[follow])
        return none if rank is None else (rank << place) | at

    def update(at, value):
        node = leaves + at
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    for i in range(n - 1):
        tree[leaves + i] = leaf(i, i + 1)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        at, rank = tree[1] & mask, tree[1] >> place
        gone = after[at]
        follow = after[gone]
        symbols[at] = int(v.made[rank])
        symbols[gone] = -1
        after[at] = follow
        if follow < n:
            before[follow] = at
        update(gone, none)
        update(at, leaf(at, follow))
        if before[at] >= 0:
            update(before[at], leaf(before[at], at))
    return np.array([s for s in symbols if s >= 0], dtype=np.int64)


class Encoder:
    """Texts to ids, with a bounded table of the chunks met so far."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def normal(chunks: str) -> str:
        """The normal form of a chunk, or of chunks joined by spaces: nothing composes, moves or depends on its neighbours over a space."""
        if chunks.isascii():
            return chunks.lower()
        # Characters are lowered one by one: a final sigma has no form of its own.
        return unicodedata.normalize("NFC", chunks).replace("Σ", "σ").lower()

    @staticmethod
    def pieces(text: str) -> list[str]:
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def _merge(self, words: list[str]) -> None:
        """Encode words that the table lacks; equal widths share an array."""
        if not words:
            return
        raw = [w.encode() for w in words]
        sizes = np.array(list(map(len, raw)))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = self.v.byte_id[flat]
        ids[ends - 1] = self.v.end_id[flat[ends - 1]]
        starts = ends - sizes
        for i in np.flatnonzero(sizes > LONG).tolist():
            self.words[words[i]] = merge_alone(self.v, ids[starts[i]:ends[i]].tolist()).astype("<u4").tobytes()
        width = 1
        while width <= LONG:
            group = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            most = max(1, _PLACES // width)
            for first in range(0, len(group), most):
                part = group[first:first + most]
                lengths = sizes[part]
                inside = np.arange(width) < lengths[:, None]
                symbols = np.zeros((len(part), width), dtype=np.int64)
                symbols[inside] = ids[(starts[part][:, None] + np.arange(width))[inside]]
                made, counts = merge_together(self.v, symbols, lengths)
                packed, to = made.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                self.words.update(zip((words[i] for i in part.tolist()), (packed[a:b] for a, b in zip([0, *to], to))))
            width *= 2

    def _learn(self, order: list[str]) -> None:
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        # Flat lists by kind: a container for each chunk would be work for the garbage collector.
        alone, words, ended, heads, ends, other, split = [], [], [], [], [], [], []
        for chunk, c in zip(order, self.normal(" ".join(order)).split(" ")):
            if c.isalpha():
                alone.append(chunk)
                words.append(c)
            elif c[-1] in ".,;:!?" and c[:-1].isalpha():
                ended.append(chunk)
                heads.append(c[:-1])
                ends.append(c[-1])
            else:
                other.append(chunk)
                split.append(_WORD.findall(c))
        self._merge(list({*words, *heads, *ends}.union(*split).difference(self.words)))
        get = self.words.__getitem__
        self.chunks.update(zip(alone, map(get, words)))
        self.chunks.update(zip(ended, map(add, map(get, heads), map(get, ends))))
        self.chunks.update(zip(other, [b"".join(map(get, w)) for w in split]))

    def _found(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks = {c: self.chunks[c] for c in chunks if c in self.chunks}
        ids = list(map(self.chunks.get, chunks))
        missing = [i for i, found in enumerate(ids) if found is None]
        if missing:
            unknown = [chunks[i] for i in missing]
            self._learn(unknown)
            for i, made in zip(missing, map(self.chunks.__getitem__, unknown)):
                ids[i] = made
        return ids

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens, cut at white space by Arrow; each distinct chunk is looked up once."""
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = distinct.index("") if "" in distinct else None  # before leading and after trailing white space
        found = self._found([c for c in distinct if c])
        if at is not None:
            found.insert(at, b"")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), dtype="<u4")
        places = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes[places])))
        out = np.empty(ends[-1], dtype="<u4")
        for first in range(0, len(places), _PART):
            part = places[first:first + _PART]
            a, b = ends[first], ends[first + len(part)]
            out[a:b] = every[np.repeat(starts[part] - ends[first:first + len(part)] + a, sizes[part]) + np.arange(b - a)]
        edges = ends[cut.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def _special(self, text: str) -> bytes:
        parts = self.v.split_special.split(text) if self.v.split_special is not None else [text]
        cut = [[] if i % 2 else self.pieces(p) for i, p in enumerate(parts)]
        distinct = list(set().union(*cut))
        get = dict(zip(distinct, self._found(distinct))).__getitem__
        return b"".join([self.v.special[p].to_bytes(4, "little") if i % 2 else b"".join(map(get, c)) for i, (p, c) in enumerate(zip(parts, cut))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = {i: self._special(t) for i, t in enumerate(texts) if any(s in t for s in self.v.special) or _ODD.search(t)}
        plain = iter(self._plain([t for i, t in enumerate(texts) if i not in odd]))
        return [odd[i] if i in odd else next(plain) for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, special ones included, joined by spaces: the file names no decoder."""
        return " ".join(self.v.tokens[ids].tolist())


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder, with its tables, for each worker process."""
    return Encoder(path)


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of their texts."""
    enc = encoder(path)
    for batch in batches:
        texts = batch.column(text_at)
        for start, end in slices([len(t) if (t := s.as_buffer()) is not None else 0 for s in texts]):
            part = batch.slice(start, end - start)
            yield part, enc.encode([t or "" for t in part.column(text_at).to_pylist()])


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))


def _encode_run(path: str):
    def run(batches):
        for part, ids in encoded_batches(batches, path, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["doc_id", "ids"])
    return run


def _decode_run(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            sizes = [4 * (s or 0) for s in batch.column(1).value_lengths().to_pylist()]
            for start, end in slices(sizes):
                part = batch.slice(start, end - start)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.cumsum([s // 4 for s in sizes[start:end]])))
                text = pa.array([enc.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["doc_id", "ids", "decoded"])
    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def _id_type(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every whole text."""
    rows = _texts(df, id_col, text_col)
    return rows.mapInArrow(_encode_run(path), f"{_id_type(rows)}, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """Rows of doc_id and ids with the decoded text."""
    rows = df.select("doc_id", "ids")
    return rows.mapInArrow(_decode_run(path), f"{_id_type(rows)}, ids array<int>, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(...)) in one pass of one worker: doc_id, ids, decoded."""
    encoding, decoding = _encode_run(path), _decode_run(path)
    rows = _texts(df, id_col, text_col)
    return rows.mapInArrow(lambda batches: decoding(encoding(batches)), f"{_id_type(rows)}, ids array<int>, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    """Counts and digests of encoded and decoded rows."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
