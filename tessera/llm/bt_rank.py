"""Quality by Bradley-Terry pairwise ranking, then a quantile of the score.

The labelled rows (a bounded sample, ``sample_rows``) give preference pairs:
each row of the better class is set against ``rivals`` rows of the other.  The
score s(x) = w.x over hashed word and byte n-gram frequencies maximises

    sum over pairs  log sigmoid(s(better) - s(worse))

so only feature differences matter; a monotone logistic map, fitted on the
rows held back from the pairs, then puts the score on 0..1 without changing
the ranking.  Beside the n-grams, x has a few shares of the text (echoed,
distinct and repeated words, repeated lines, symbols, word length, length).
``by_quantile`` keeps the documents at or above a quantile of the scores of
*all* documents (an approximate percentile with ``accuracy``, a mergeable
sketch, so no sort and no driver).

Null and empty texts have no features and get the score of the offset.  Rows
with equal scores are kept or dropped together; repeated rows give one result each; null ids pass through; an empty table gives an empty result.  Without
both classes the score is the label rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import collect_sample, fold, keep, labelled_sample, release
from .grams import Grams
from .linear import adam, platt, sigmoid
from .quality_ngram import counts

THRESHOLD = 0.3
N_SHARES = 8


@dataclass(frozen=True)
class Params:
    sample_rows: int = 6_000
    rivals: int = 8
    l2: float = 1e-4
    steps: int = 200
    quantile: float = 0.2
    accuracy: int = 10_000
    seed: int = 11
    grams: Grams = Grams(bits=14, orders=(3,))


@dataclass(frozen=True)
class Ranker:
    grams: Grams
    weights: np.ndarray
    shares: np.ndarray
    a: float
    b: float

    def raw(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.grams.score(self.weights, data, offs) + shares(data, offs) @ self.shares

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.raw(data, offs) + self.b)


def shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = counts(data, offs)
    h, d, _, _ = K.words(data, offs)
    echo = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=len(offs) - 1)
    kinds = np.bincount(K.unique_pairs(d, h)[0], minlength=len(offs) - 1)
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return 4 * np.stack([5 * echo / words, 3 * kinds / words, c["n_repeat_words"] / words, 10 * c["n_dup_lines"] / words, c["n_symbols"] / chars,
                     chars / words / 10, np.log1p(c["n_words"]) / 5, c["n_words"] < 10], axis=1).astype(float)


def pairs(y: np.ndarray, rivals: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse) row numbers: every row is in ``rivals`` pairs at least."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, rivals), rng.choice(good, len(bad) * rivals)])
    b = np.concatenate([rng.choice(bad, len(good) * rivals), np.repeat(bad, rivals)])
    return a, b


def fit(texts: pa.Array, y: np.ndarray, p: Params = Params()) -> Ranker:
    """Pairs among four fifths of the rows, the logistic map on the others (on
    all rows where either side lacks a class)."""
    none = np.zeros(N_SHARES)
    if len(y) == 0 or y.min() == y.max():
        return Ranker(p.grams, np.zeros(p.grams.dim), none, *platt(np.zeros(len(y)), y))
    x = p.grams.rows(texts)
    z = np.concatenate([shares(data, offs) for _, _, data, offs in K.chunks(texts)])
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    rows = np.flatnonzero(~held)
    better, worse = (rows[i] for i in pairs(y[rows], p.rivals, p.seed))

    def grad(w):
        s = x.dot(w[:x.dim]) + z @ w[x.dim:]
        g = -sigmoid(s[worse] - s[better]) / len(better)  # d/d(difference) of the logistic loss
        c = np.bincount(better, weights=g, minlength=len(y)) - np.bincount(worse, weights=g, minlength=len(y))
        return np.append(x.t_dot(c), c @ z) + p.l2 * w

    w = adam(grad, np.zeros(x.dim + N_SHARES), p.steps)
    at = held if held.any() else ~held
    s = x.dot(w[:x.dim]) + z @ w[x.dim:]
    return Ranker(p.grams, w[:x.dim].astype(np.float32), w[x.dim:], *platt(s[at], y[at]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where=None, p: Params = Params()) -> Ranker:
    texts, y, _ = collect_sample(labelled_sample(docs, labels, label, p.sample_rows, where))
    model = fit(texts, y, p)
    del texts
    release()
    return model


def score(docs: DataFrame, ranker: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of 0..1; an input column ``out`` is replaced."""
    cols = [c for c in docs.columns if c != out]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    i = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for lo, hi, data, offs in K.chunks(b.column(i)):
                s[lo:hi] = ranker.score(data, offs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.limit(0).withColumn(out, F.lit(0.0)).schema)


def by_quantile(scored: DataFrame, q: float, out: str = "kept", score: str = "score",
                accuracy: int = 10_000) -> DataFrame:
    """scored with ``out``: is the score at least the q-quantile of all scores?"""
    cut = scored.agg(F.percentile_approx(score, F.lit(q), F.lit(accuracy)).alias("_cut"))
    return (scored.drop(out).crossJoin(F.broadcast(cut))  # one row
            .withColumn(out, F.coalesce(F.col(score) >= F.col("_cut"), F.lit(False))).drop("_cut"))


def op8(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted, kept of every document; labels of fold 0 unseen."""
    s = score(docs.select("doc_id", "text"), train(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, p))
    s = keep(s.select("doc_id", "score"))  # scored once, for the quantile and the result
    return by_quantile(s, p.quantile, accuracy=p.accuracy).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "kept")
