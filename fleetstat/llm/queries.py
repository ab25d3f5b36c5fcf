"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetstat.llm import audit, bpe, exact, idstore, langid, minhash, neighbours, packing, phrases, secrets, sharding, suffixes, wrappers
from fleetstat.llm.common import scratch, ship, table


WORDS = public_tokenizers.path("word_bpe_49k.json")


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), PIECES)


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents"), WORDS))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents"), n_shards=16))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(suffixes.remove(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(exact.classes(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked(table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(minhash.groups(table(spark, sf_dir, "documents"), words=3, percent=85))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(packing.sequences(table(spark, sf_dir, "documents"), WORDS, with_tokens=False))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.report(wrappers.extract(table(spark, sf_dir, "pages")))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = idstore.write(docs, WORDS, scratch(spark, "store"))
    return idstore.report(idstore.read(store, docs))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_bpe_encoding": op2_bpe_encoding,
    "op3_sharding": op3_sharding,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_secret_scans": op10_secret_scans,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_token_id_output": op12_token_id_output,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}


EXACT_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""

NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of ON a = d.doc_id
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT x.vec_id, coalesce(n, 0) AS n_links, least(x.vec_id, coalesce(l.b, x.vec_id)) AS component_id, x.vec_id <= coalesce(l.b, x.vec_id) AS kept
FROM embeddings x LEFT JOIN least_of l ON l.a = x.vec_id LEFT JOIN degrees d ON d.a = x.vec_id
"""

PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 5) t(k)),
counted AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, phrase, a, c.k, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
  FROM counted c, range(1, 4) t(j) WHERE c.k > j),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, ((2000000 * cuts.a::HUGEINT) // (x.a + y.a))::BIGINT AS score,
         row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000 * cuts.a::HUGEINT) // (x.a + y.a), j) AS place
  FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = head JOIN counted y ON y.lang = cuts.lang AND y.phrase = tail),
inside AS (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))) AS phrase
  FROM counted, range(2, 4) t(m) WHERE k > m),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longest g ON g.lang = s.lang AND g.phrase = s.phrase WHERE place = 1 AND coalesce(100 * longer < 80 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
least_of AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY ALL),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
    CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM words JOIN least_of USING (t) LEFT JOIN said USING (doc_id)),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
permuted AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM permuted),
cells AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
judged AS (
  SELECT part, filter_order, step, filter_order[step] AS x, good, toxic, n, fails, list_contains(fails, filter_order[step]) AS here,
         len(list_filter(fails, lambda y: contains(filter_order[1:step - 1], y))) > 0 AS before FROM cells, steps),
summed AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT before AND NOT here THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN here AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND len(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN here AND NOT before AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN here AND NOT before AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM summed
"""


def oracle_sql() -> dict[str, str]:
    sql = {"op5_exact_dedup": EXACT_SQL, "op6_embedding_near_dedup": VECTOR_SQL, "op7_minhash_near_dedup": NEAR_SQL, "op11_phrase_collocations": PHRASE_SQL, "op13_filter_interaction_audit": AUDIT_SQL,
           "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
