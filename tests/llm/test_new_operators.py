"""Phrases, id stores and filter audits against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from compare import differences
from fixtures import AWKWARD, documents, prose
from fleetstat.llm import audit, idstore, phrases, queries
from fleetstat.llm.common import scratch

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", ["op11_phrase_collocations", "op13_filter_interaction_audit"])
def test_sql_twin(key, spark, duck):
    assert differences(queries.queries()[key](spark, SF), duck.sql(queries.oracle_sql()[key])) == []


# Phrases.

def brute_phrases(rows, least, longest=4, held=80, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = defaultdict(list)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(lang == other and len(q) > len(p) and 100 * b >= held * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                     for (other, q), b in candidates.items())
        if not inside:
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


def phrase_rows():
    texts = prose(5, 60, 90)
    rows = [("en" if i % 3 else "de", t) for i, t in enumerate(texts)]
    shared = "New York city Hall, ab\tcd  ef. Gh ij\x0bkl mn; op"
    rows += [("en", shared)] * 9 + [(None, shared), ("und", shared)] * 4 + [("de", "x x x x x x x! é ß é ß é ß."), ("de", None), ("de", ""), ("fr", " \t\n.")]
    rows += [("en", "a b " * 30000 + "end")]
    return rows


@pytest.mark.parametrize("least, shards, top", [(4, 3, 2000), (4, 1, 3), (2, 7, 2000)])
def test_phrases_against_brute_force(spark, least, shards, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(i, t, lang, "a") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(4)
    got = {tuple(r) for r in phrases.collocations(df, least=least, shards=shards, top=top, bits=12).collect()}
    assert got == brute_phrases(rows, least, top=top)


def test_local_support_loses_no_phrase():
    """In some shard every frequent phrase reaches the shard's share of the support."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        words = rng.integers(1, 50, 6)
        least, total = 30, int(words.sum())
        needed = [-(-least * int(w) // total) for w in words]
        counts = np.array([max(0, x - 1) for x in needed])
        assert counts.sum() < least


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 40)
    texts = [("ab cd " * 3 + ". ef gh, " * 9 + "x" * 200).encode(), b"", b"one two. three"]
    whole = b"\n".join([*texts, b""])
    parts = list(phrases._segments(texts))
    assert b"".join(d.tobytes() for d, _ in parts) == whole and len(parts) > 2
    assert all(d[-1] in b".,\n" for d, _ in parts)
    owners = [[int(np.searchsorted(ends, i, side="right")) for i in range(len(d))] for d, ends in parts]
    assert sum(owners, []) == [0] * (len(texts[0]) + 1) + [1] + [2] * (len(texts[2]) + 1)


def test_phrases_of_empty_and_awkward_tables(spark):
    assert phrases.collocations(documents(spark, []).select("doc_id", "text", "lang")).collect() == []
    got = {tuple(r) for r in phrases.collocations(documents(spark), least=3, shards=2).collect()}
    langs = ["en" if k % 2 else None for k in range(len(AWKWARD))]
    assert got == brute_phrases([(lang, t) for lang, (_, t) in zip(langs, AWKWARD)], 3)


# Id stores.

def expected_ids(rows, tokenizer):
    out, start = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes, partitions", [(1 << 27, 3), (300, 2)])
def test_store_round_trip(spark, shard_bytes, partitions):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(i * 7 - 50, t) for i, t in enumerate(prose(8, 40, 30))] + [(1000, "Bold text's <|endoftext|> 12 é 日本")]
    df = spark.createDataFrame([(k, t, "f", 3) for k, t in rows], "doc_id long, text string, file string, start int").repartition(5)
    store = idstore.write(df, WORDS, scratch(spark, "store"), shard_bytes=shard_bytes, partitions=partitions, part_keys=10)
    got = sorted(tuple(r) for r in idstore.report(idstore.read(store, df)).collect())
    assert got == expected_ids(sorted(rows), tokenizer)
    assert store.width == 2 and store.n_parts == 5
    some = dict(rows)
    for key in (-50, 6, 1000):
        (ids,) = idstore.get(store, spark, key)
        assert ids.tolist() == [*tokenizer.encode(some[key], add_special_tokens=False).ids, 2]
    assert idstore.get(store, spark, 5) == [] and idstore.get(store, spark, None) == []
    unknown = spark.createDataFrame([(k,) for k in [5, 6, 6, None, 99999]], "doc_id long")
    assert [r["key"] for r in idstore.read(store, unknown).collect()] == [6]


@pytest.mark.parametrize("shard_bytes", [1 << 27, 40])
def test_store_of_awkward_rows(spark, shard_bytes):
    """Null and repeated keys: all rows of a key come back, from as many shards as they take."""
    df = documents(spark)
    store = idstore.write(df, WORDS, scratch(spark, "store"), shard_bytes=shard_bytes, partitions=2, part_keys=2)
    got = idstore.report(idstore.read(store, df)).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter((k, n, crc) for k, _, n, crc in expected_ids(AWKWARD, tokenizer))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    assert sum(map(len, idstore.get(store, spark, 7))) == sum(n for k, n, _ in want.elements() if k == 7)


def test_empty_store(spark):
    df = documents(spark, [])
    store = idstore.write(df, WORDS, scratch(spark, "store"))
    assert idstore.read(store, df).collect() == [] and idstore.get(store, spark, 1) == []


def test_perfect_hash():
    for n in (0, 1, 2, 63, 5000):
        a, b = idstore.hashes([f"key {i}" for i in range(n)])
        function = idstore.PerfectHash.build(a, b)
        assert sorted(function.find(a, b).tolist()) == list(range(n))
        again, entries = idstore._index_of(b"".join(idstore._index_bytes(function, np.zeros(n, idstore.ENTRY))))
        assert (again.find(a, b) == function.find(a, b)).all() and len(entries) == n
        if n == 5000:
            assert 8 * (function.words.nbytes + function.before.nbytes) / n < 10
    a, b = idstore.hashes(["same", "same"])
    with pytest.raises(ValueError):
        idstore.PerfectHash.build(a, b)


# Filter audits.

def brute_audit(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    fails = []
    for k, text, part in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and k > least[t]}
        fails.append((part or "", {x for x in f if f[x]}, k in good, k in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        removed_of = Counter()
        for order in itertools.permutations("ABCDE"):
            for s, x in enumerate(order):
                c = Counter()
                for p, f, g, t in fails:
                    if p == part:
                        gone, here = bool(f & set(order[:s])), x in f
                        c["kept"] += not gone and not here
                        c["removed"] += here and not gone
                        c["redundant"] += here and gone
                        c["unique_fails"] += f == {x}
                        c["good_lost"] += here and not gone and g
                        c["toxic_lost"] += here and not gone and t
                removed_of[x] += c["removed"]
                out[part, "".join(order), s + 1] = c
        for (p, order, step), c in out.items():
            if p == part:
                c["shapley"] = removed_of[order[step - 1]]
    return {(*key, *(c[n] for n in (*audit.COUNTERS, "shapley"))) for key, c in out.items()}


def audit_rows():
    base = prose(2, 8, 230)
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(base)]
    rows += [(i + 100, base[i % 2], "en") for i in range(20)] + [(3, base[0], "de"), (0, base[0], "en"), (None, base[0], "en"), (None, "rare", "")]
    rows += [(200, "A" * 50 + " $ é", "xx"), (201, "same " * 300, "xx"), (202, None, "xx"), (203, "", "xx"), (-1, "", None)]
    labels = [(0, 1, 0), (1, 0, 1), (101, 1, 1), (101, 0, 0), (None, 1, 1), (9999, 1, 1), (201, None, 1)]
    return rows, labels


def test_audit_against_brute_force(spark):
    rows, labels = audit_rows()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int").repartition(3)
    said = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = [tuple(r) for r in audit.audit(df, said).collect()]
    assert len(got) == 600 * 4 and set(got) == brute_audit(rows, labels)
    alone = audit.audit(df).where("good_lost + toxic_lost > 0")
    assert alone.count() == 0


def test_many_parts_and_no_rows(spark, monkeypatch):
    rows = [(i, f"text {i % 40}", f"p{i % 300}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = audit.audit(df).where("filter_order = 'ABCDE' and step = 1").collect()
    assert len(got) == 300 and sum(r["kept"] + r["removed"] for r in got) == 900
    assert audit.audit(documents(spark, [])).collect() == []


def test_fields_do_not_overflow():
    whole = (1 << 63) - 1
    number = whole * audit.packed(0b10101, True, False)
    fields = np.frombuffer(number.to_bytes(audit._size(), "little"), "<u8")
    assert set(fields.tolist()) == {0, whole}


def test_digest_is_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000, "en")], "doc_id long, text string, lang string")
    (row,) = audit.masks(df).collect()
    assert row["digest"] == hashlib.sha256(("é" * 2_000_000).encode()).digest() and row["mask"] == 1
