"""Language identification by unigram models summed over all segmentations.

The pieces are those of a fixed public vocabulary: letters in lower case, with or
without the word-start mark. Each language has a probability for each piece. A
forward pass over a word adds up the probabilities of all its segmentations into
pieces, so a word's score does not depend on one chosen segmentation; a text's
score is the sum of its words' log scores. Probabilities are fitted by
expectation-maximisation, whose expectation step is the same forward pass with
its mirror image.

Training: word counts of at most about SAMPLE labelled rows of each language
(chosen by a hash of the identifier among the rows allowed for training; this
documented bound is the only sample in the operator). Counts are kept as a table
in the shared folder; a step sends one number for each piece and language to
the driver, whatever the corpus.

Training leaves out words of more than LONGEST letters.

Prediction reads every whole text. Words are runs of Unicode letters of the lowered
text. Words up to LONGEST letters are scored many at once and kept in a bounded table
of each worker process; longer ones, of any length, are scored alone by the same
forward pass in a window that slides over them.

Defined results: a null text, or one without a letter, is `und` with score 0;
with no training rows everything is `und`; equal totals go to the first language
in alphabetical order; a null identifier is never held out; repeated rows give
repeated results; columns other than identifier, text and label are not read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import slices, text_of, written

UNKNOWN = "und"
MARK = "▁"
#: Labelled rows of each language that training takes, in expectation.
SAMPLE = 1000
ROUNDS = 4
#: Letters of a word up to which words share a lattice.
LONGEST = 31
#: Words whose lattices are in memory together, and bytes of text whose words are.
TOGETHER, SLICE = 4_000, 2 << 20
#: Probability of a character outside the vocabulary, and of a piece never met.
STRANGE, SMOOTHING = 1e-9, 0.01
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
_SCALE = 1 << 20


class Pieces:
    """The letter pieces of a vocabulary file, and a finder of all their places in words."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.names = sorted({p for p in names if (body := p.removeprefix(MARK)).isalpha() and body == body.lower() or p == MARK})
        self.widest = max(map(len, self.names), default=0)
        self.finder = ahocorasick.Automaton()
        for i, p in enumerate(self.names):
            self.finder.add_word(p, i)
        self.finder.make_automaton()

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """For marked words: lengths, and word, start, end and piece of every place where a piece fits."""
        joined = "".join(words)
        lengths = np.array(list(map(len, words)), dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        found = np.array(list(self.finder.iter(joined)), dtype=np.int64).reshape(-1, 2)
        last, piece = found[:, 0], found[:, 1]
        size = np.array(list(map(len, self.names)), dtype=np.int64)[piece]
        word = np.repeat(np.arange(len(words)), lengths)[last]
        end = last + 1 - first[word]
        order = np.argsort(end, kind="stable")
        return lengths, word[order], (end - size)[order], end[order], piece[order]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. Number characters that are no digits (fractions, circled numbers) are not letters."""
    found = _WORD.findall((text or "").lower())
    if text is None or text.isascii():
        return found
    return [w for f in found for w in ((f,) if f.isalpha() else _LETTERS.findall(f))]


def forward(lattice, prob: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: summed probability of all ways to reach a place."""
    lengths, word, start, end, piece = lattice
    n, most, langs = len(lengths), int(lengths.max(initial=0)), prob.shape[1]
    alpha = np.zeros((n, most + 1, langs))
    alpha[:, 0] = 1
    cuts = np.searchsorted(end, np.arange(1, most + 2))
    for k in range(1, most + 1):
        at = slice(cuts[k - 1], cuts[k])
        flow = alpha[word[at], start[at]] * prob[piece[at]]
        for lang in range(langs):
            alpha[:, k, lang] = np.bincount(word[at], flow[:, lang], n)
        alpha[:, k] += alpha[:, k - 1] * STRANGE
    return alpha


def backward(lattice, prob: np.ndarray) -> np.ndarray:
    """beta[word, place, language]: summed probability of all ways from a place to the end of the word."""
    lengths, word, start, end, piece = lattice
    n, most, langs = len(lengths), int(lengths.max(initial=0)), prob.shape[1]
    beta = np.zeros((n, most + 1, langs))
    beta[np.arange(n), lengths] = 1
    order = np.argsort(start, kind="stable")
    word, start, end, piece = word[order], start[order], end[order], piece[order]
    cuts = np.searchsorted(start, np.arange(0, most + 1))
    for k in range(most - 1, -1, -1):
        at = slice(cuts[k], cuts[k + 1])
        flow = beta[word[at], end[at]] * prob[piece[at]]
        for lang in range(langs):
            beta[:, k, lang] += np.bincount(word[at], flow[:, lang], n)
        beta[:, k] += beta[:, k + 1] * STRANGE
    return beta


def log_score_alone(p: Pieces, word: str, prob: np.ndarray) -> np.ndarray:
    """Log probability of a word of any length: the forward pass keeps as many places as the longest piece and scales them."""
    marked, width = MARK + word, p.widest + 1
    window, scale = np.zeros((width, prob.shape[1])), np.zeros(prob.shape[1])
    window[0] = 1
    ends = p.finder.iter(marked)
    end, piece = next(ends, (len(marked), -1))
    for k in range(1, len(marked) + 1):
        now = window[(k - 1) % width] * STRANGE
        while end == k - 1:
            now = now + window[(k - len(p.names[piece])) % width] * prob[piece]
            end, piece = next(ends, (len(marked), -1))
        window[k % width] = now
        if k % 8 == 0:
            most = window.max(axis=0)
            window /= most
            scale += np.log(most)
    return np.log(np.maximum(window[len(marked) % width], 1e-300)) + scale


def log_scores(p: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), prob.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
    for first in range(0, len(short), TOGETHER):
        part = short[first:first + TOGETHER]
        lattice = p.lattice([MARK + words[i] for i in part])
        alpha = forward(lattice, prob)
        out[part] = np.log(np.maximum(alpha[np.arange(len(alpha)), lattice[0]], 1e-300))
    if len(short) < len(words):
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = log_score_alone(p, w, prob)
    return out


def expected(p: Pieces, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations."""
    total = np.zeros((len(p.names), prob.shape[1]))
    for i in range(0, len(words), 10_000):
        lattice = p.lattice([MARK + w for w in words[i:i + 10_000]])
        lengths, word, start, end, piece = lattice
        alpha, beta = forward(lattice, prob), backward(lattice, prob)
        whole = np.maximum(alpha[np.arange(len(lengths)), lengths], 1e-300)
        use = alpha[word, start] * prob[piece] * beta[word, end] * (counts[i:i + 10_000] / whole)[word]
        for lang in range(prob.shape[1]):
            total[:, lang] += np.bincount(piece, use[:, lang], len(total))
    return total


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(df: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages met and the piece probabilities, one column for each."""
    spark = df.sparkSession
    labelled = df.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, names = sorted(rows), len(pieces(path).names)
    if not langs:
        return [], np.zeros((names, 0))
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / rows[lang]) * _SCALE))).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(_SCALE)) < share).select("text", "lang")

    def count(batches):
        for batch in batches:
            totals: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals.update((w, lang) for w in words_of(text) if len(w) <= LONGEST)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in totals], pa.string()), pa.array([g for _, g in totals], pa.string()), pa.array(list(totals.values()), pa.int64())],
                ["word", "lang", "n"])

    tally = chosen.mapInArrow(count, "word string, lang string, n long")
    columns = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("double").alias(f"n_{i}") for i, lang in enumerate(langs)]
    words = written(tally.groupBy("word").agg(*columns), "words")

    prob = np.full((names, len(langs)), 1 / names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(prob)

        def step(batches):
            p, now = pieces(path), shared.value
            total = np.zeros(now.shape)
            for batch in batches:
                total += expected(p, batch.column(0).to_pylist(), np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]), now)
            used = np.flatnonzero(total.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], ["piece", "uses"])  # noqa: B023

        uses = words.mapInArrow(step, "piece long, uses array<double>")
        sums = uses.groupBy("piece").agg(*[F.sum(F.get("uses", F.lit(i))).alias(f"u_{i}") for i in range(len(langs))]).collect()
        total = np.full(prob.shape, SMOOTHING)
        for r in sums:
            total[r["piece"]] += r[1:]
        prob = total / total.sum(axis=0)
    return langs, prob


class Scorer:
    """Log scores of texts, with a bounded table of word scores."""

    def __init__(self, path: str, prob: np.ndarray):
        self.p, self.prob = pieces(path), prob
        self.most = min(250_000, (64 << 20) // (8 * max(1, prob.shape[1])))
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, prob.shape[1]))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log scores, and the number of words."""
        found, long = list(map(words_of, texts)), np.zeros((len(texts), self.prob.shape[1]))
        sizes = np.array(list(map(len, found)), dtype=np.int64)
        for i, words in enumerate(found):
            if words and len(max(words, key=len)) > LONGEST:
                long[i] = log_scores(self.p, [w for w in words if len(w) > LONGEST], self.prob).sum(axis=0)
                found[i] = [w for w in words if len(w) <= LONGEST]
        if len(self.place) > self.most:
            self.place, self.scores = {}, np.zeros((0, self.prob.shape[1]))
        new = set().union(*found).difference(self.place)
        if new:
            order = list(new)
            self.place.update(zip(order, range(len(self.place), len(self.place) + len(order))))
            self.scores = np.concatenate([self.scores, log_scores(self.p, order, self.prob)])
        get = self.place.__getitem__
        out = long
        for i, words in enumerate(found):
            if words:
                out[i] += self.scores[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return out, sizes


def predict(df: DataFrame, langs: list[str], prob: np.ndarray, path: str, text_col: str = "text") -> DataFrame:
    """The rows as a struct `record`, with lang_pred and score."""
    rows = df.select(F.struct("*").alias("record"), text_of(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(prob)

    def run(batches):
        scorer = Scorer(path, shared.value)
        for batch in batches:
            for start, end in slices([len(t.as_buffer()) for t in batch.column(1)], SLICE):
                part = batch.slice(start, end - start)
                totals, words = scorer.totals(part.column(1).to_pylist())
                if langs:
                    weight = np.exp(totals - totals.max(axis=1, keepdims=True))
                    best, score = totals.argmax(axis=1), weight.max(axis=1) / weight.sum(axis=1)
                    names = [langs[b] if n else UNKNOWN for b, n in zip(best, words)]
                    score = np.where(words > 0, score, 0.0)
                else:
                    names, score = [UNKNOWN] * len(part), np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["record", "lang_pred", "score"])

    schema = rows.select("record", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score; trained on the rows that are not held out."""
    langs, prob = train(df, path, sample, ROUNDS, id_col, text_col, lang_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    narrow = predict(rows, langs, prob, path)
    return narrow.select("record.doc_id", held_out("record.doc_id").alias("held_out"), "lang_pred", "score")


def accepted(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows in one of the learned languages, with all their columns."""
    langs, prob = train(df, path, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(df, langs, prob, path, text_col).where(F.col("lang_pred") != UNKNOWN).select("record.*")
