"""Language ID: per-language piece probabilities, text scored by the sum over all segmentations into pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction_for, in_fraction, materialize
from .pieces import MARK, Vocabulary, matrix, vocabulary, walk
from .tokens import tokenizer_file

#: Letter runs, which are the words; other characters say little of a language.
WORDS = re.compile(r"[^\W\d_]+")
#: Expected number of training documents of each language, taken by a hash of doc_id.
TRAIN_DOCS = 2_000
#: Rounds of expectation maximisation, and what each piece gets besides its expected count.
ROUNDS, SMOOTH = 3, 0.05
#: Factor a byte keeps products of small probabilities within doubles; it cancels out between languages. Steps after which
#: sums are scaled, so that words of any length stay within them, too.
LIFT, RESCALE = 256.0, 16
#: Words that a worker remembers, of at most so many characters; cells of a matrix of words.
CACHED, SHORT, CELLS = 200_000, 64, 1 << 19
#: Languages that a model may have: its size is their number times that of the vocabulary, and it is broadcast.
MOST_LANGS = 256


def words_of(text: str) -> list[str]:
    words = WORDS.findall(text.lower())
    if not all(map(str.isalpha, words)):  # numerals that are not digits
        words = [w for w in ("".join(filter(str.isalpha, w)) for w in words) if w]
    return words


def _edges_from(vocab: Vocabulary, codes: np.ndarray, s: int):
    """(end, rows, pieces) of all pieces that begin at s in all words, bytes included."""
    rows = np.flatnonzero(codes[:, s] > 0)
    if not len(rows):
        return
    single = vocab.byte_ids[codes[rows, s] - 1]
    if not np.all(single >= 0):  # a vocabulary without bytes: one unknown piece stands for each
        single = np.where(single >= 0, single, vocab.unknown)
    yield s + 1, rows, single
    for end, at, ids in walk(vocab.trie, codes, rows, s):
        yield end, rows[at], ids


def _blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words of about one length, their bytes as a matrix, their lengths; a matrix has CELLS cells, or one word."""
    coded = [(MARK + w).encode("utf-8", "surrogatepass") for w in words]
    order, lo = np.argsort([len(w) for w in coded], kind="stable"), 0
    while lo < len(order):
        hi = min(len(order), lo + 4096)
        while hi > lo + 1 and (hi - lo) * len(coded[order[hi - 1]]) > CELLS:
            hi = lo + (hi - lo) // 2
        yield (order[lo:hi], *matrix([coded[i] for i in order[lo:hi]]))
        lo = hi


def _forward(vocab: Vocabulary, codes: np.ndarray, lengths: np.ndarray, by_piece: np.ndarray, alpha: np.ndarray):
    """Forward sums, step by step: yields s when column s of the window `alpha` (column s modulo its width) is complete, with
    the log by which each row and language has been scaled so far. Scaled every few steps, so no sum vanishes.

    A word's own sums are complete at its length. The window is as wide as the longest piece.
    """
    width, scale = alpha.shape[1], np.zeros((len(codes), alpha.shape[2]))
    alpha[:, 0] = 1
    for s in range(codes.shape[1]):
        if s and s % RESCALE == 0:
            top = alpha.max(1)
            top = np.where(top > 0, top, 1)
            alpha /= top[:, None]
            scale += np.log(top)
        yield s, scale
        own = alpha[:, s % width].copy()
        alpha[:, s % width] = 0
        for end, rows, ids in _edges_from(vocab, codes, s):
            alpha[rows, end % width] += own[rows] * by_piece[ids] * LIFT ** (end - s)


def log_likelihood(vocab: Vocabulary, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations, lifted, for each whole word and language. probs: languages x pieces."""
    out, by_piece, width = np.empty((len(words), len(probs))), np.ascontiguousarray(probs.T), vocab.longest + 1
    for some, codes, lengths in _blocks(words):
        alpha = np.zeros((len(some), min(width, codes.shape[1]), len(probs)))
        for s, scale in _forward(vocab, codes, lengths, by_piece, alpha):
            rows = np.flatnonzero(lengths == s)
            if len(rows):
                out[some[rows]] = np.log(alpha[rows, s % alpha.shape[1]]) + scale[rows]
    return out


def expected_counts(vocab: Vocabulary, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of weighted words of one language: forward and backward sums."""
    counts, width, by_piece = np.zeros(len(probs)), vocab.longest + 1, np.ascontiguousarray(probs[:, None])
    for some, codes, lengths in _blocks(words):
        n, steps = codes.shape
        window = np.zeros((n, min(width, steps), 1))
        alpha, scales, total = np.zeros((n, steps)), np.zeros((n, steps)), np.zeros(n)
        for s, scale in _forward(vocab, codes, lengths, by_piece, window):
            alpha[:, s], scales[:, s] = window[:, s % window.shape[1], 0], scale[:, 0]
            rows = np.flatnonzero(lengths == s)
            total[rows] = np.log(alpha[rows, s]) + scales[rows, s]
        beta, behind = np.zeros((n, min(width, steps))), np.zeros(n)
        width_ = beta.shape[1]
        for s in range(steps - 1, -1, -1):
            if s % RESCALE == 0:
                top = beta.max(1)
                top = np.where(top > 0, top, 1)
                beta /= top[:, None]
                behind += np.log(top)
            own = (lengths == s).astype(float)
            edges = [(rows, ids, probs[ids] * LIFT ** (end - s), end) for end, rows, ids in _edges_from(vocab, codes, s)]
            for rows, _, q, end in edges:
                own[rows] += q * beta[rows, end % width_]
            share = weights[some] * alpha[:, s] * np.exp(np.minimum(scales[:, s] + behind - total, 700))
            for rows, ids, q, end in edges:
                counts += np.bincount(ids, share[rows] * q * beta[rows, end % width_], len(counts))
            beta[:, s % width_] = own
    return counts


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from collections import Counter

    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b["lang"], b["text"].fillna("")):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])


def _count_pieces(file: str, langs: list[str], probs: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, counts = vocabulary(file), np.zeros_like(probs)
        for b in batches:
            for lang, x in b.groupby("lang"):
                k = langs.index(lang)
                counts[k] += expected_counts(vocab, x["word"].tolist(), x["n"].to_numpy(float), probs[k])
        at = np.nonzero(counts)
        yield pd.DataFrame({"lang": at[0], "piece": at[1], "n": counts[at]})

    return rows


def train(docs: DataFrame, file: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from rows with lang and text: a hash sample of about `train_docs` a language.

    Only counts for each language and piece of the fixed vocabulary pass through the driver.
    """
    file = file or tokenizer_file("piece_bpe_32k.model")
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages, more than the {MOST_LANGS} that a model may have")
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, fraction_for(train_docs, sizes[lang]))))
    sample = docs.filter(in_fraction(F.col("doc_id"), share[F.col("lang")]))
    words = sample.select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long")
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid_words")
    n = len(vocabulary(file).pieces)
    probs = np.full((len(langs), n), 1 / n)
    for _ in range(rounds):
        rows = words.mapInPandas(_count_pieces(file, langs, probs), "lang int, piece int, n double")
        got = rows.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full_like(probs, SMOOTH)
        counts[got["lang"].to_numpy(int), got["piece"].to_numpy(int)] += got["n"].to_numpy(float)
        probs = counts / counts.sum(1, keepdims=True)
    return langs, probs


class Scorer:
    """Scores texts against all languages; remembers words."""

    def __init__(self, file: str, probs: np.ndarray):
        self.vocab, self.probs = vocabulary(file), probs
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(probs)))

    def scores(self, texts: list[str]) -> list[np.ndarray | None]:
        """Log likelihood of each text in each language; None without a letter."""
        out: list[np.ndarray | None] = []
        for lo in range(0, len(texts), 64):
            words = [words_of(t) for t in texts[lo : lo + 64]]
            if len(self.place) > CACHED:
                self.place, self.table = {}, self.table[:0]
            distinct = set().union(*words)
            new = [w for w in distinct.difference(self.place) if len(w) <= SHORT]
            at = len(self.place)
            self.place.update(zip(new, range(at, at + len(new))))
            if at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty((at + len(new), len(self.probs)))])
            self.table[at : at + len(new)] = log_likelihood(self.vocab, new, self.probs)
            # Very long words are scored with the rest but not remembered.
            far = [w for w in distinct if len(w) > SHORT]
            scored = dict(zip(far, log_likelihood(self.vocab, far, self.probs)))
            for w in words:
                x = self.table[np.fromiter((self.place[v] for v in w if len(v) <= SHORT), np.int64)].sum(0) if far else self.table[np.fromiter(map(self.place.__getitem__, w), np.int64, len(w))].sum(0)
                out.append(x + sum(scored[v] for v in w if len(v) > SHORT) if w else None)
        return out


@lru_cache(1)
def _scorer(file: str, model: bytes, langs: int) -> Scorer:
    return Scorer(file, np.frombuffer(model, np.float64).reshape(langs, -1))


def prediction(spark: SparkSession, langs: list[str], probs: np.ndarray, text: str = "text", file: str | None = None) -> Column:
    """A struct of lang_pred and score (its posterior among the learned languages) for the whole text of each row.

    A column, so that rows stay where they are and only texts go to Python. The model, languages x pieces of the fixed
    vocabulary, is broadcast.

    Defined cases: null text, text without a letter, and an untrained model give `und` with score 0; equal languages go to
    the first in order.
    """
    model = spark.sparkContext.broadcast(np.ascontiguousarray(probs, np.float64).tobytes())
    place = file or tokenizer_file("piece_bpe_32k.model")

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = _scorer(place, model.value, len(langs)) if langs else None
        for texts in batches:
            best, sure = [], []
            for x in s.scores(texts.fillna("").tolist()) if s else [None] * len(texts):
                if x is None:
                    best.append("und"), sure.append(0.0)
                else:
                    p = np.exp(x - x.max())
                    best.append(langs[int(p.argmax())]), sure.append(float(p.max() / p.sum()))
            yield pd.DataFrame({"lang_pred": best, "score": sure})

    return F.pandas_udf(predict, "lang_pred string, score double")(F.col(text))


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, file: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score for each row; see prediction. Other columns are ignored; an empty table gives no row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), prediction(docs.sparkSession, langs, probs, file=file).alias("p"))
    return rows.select("doc_id", "p.lang_pred", "p.score")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, probs = train(docs.filter(crc_mod("doc_id", 4) != 2))
    return predict(docs, langs, probs).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


