"""Toxicity by a factorization machine over hashed terms.

Each text is the set of its terms (runs of letters and digits, lower-cased, and
their first bytes, 64-bit hashed).  The machine's score adds a weight per term and an inner
product of factors per pair of terms, so a pair (an insult next to a group
mention) can weigh more, or less, than its terms do alone:

    z = b + sum_i w_i + sum_{i<j} <v_i, v_j>

It is fitted on a bounded sample of labelled rows (``sample_rows``) by
AdaGrad with soft-thresholded weights.  Every term of the vocabulary, those in
``min_df`` sample rows or more, has a weight and factors.  The weights go first
(``warm`` epochs); then the factors join, shrunk by penalty / (rows with the term),
so that a rare term needs more evidence, under penalties that fall from one
stage of ``stage`` epochs to the next: strong pairs are learnt before weak ones,
and what is left for chance pairs to explain is small.  The terms are counted and looked up in the
tasks; the driver gets the vocabulary and the term numbers, no texts.  The model is at most sample rows x terms large and is
shipped to the tasks; every whole text is scored in Arrow batches.

Null and empty texts have no terms and score sigmoid(b).  Null ids, repeated
rows and extra columns pass through: one result row for each input row.  An
empty table gives an empty result.  Without labels of both classes, or without
a term in ``min_df`` sample rows, nothing can be learnt: the score is the label
rate, but half the threshold at most, so no document is predicted toxic, and the
machine is not ``usable``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import fold, keep, labelled_sample, release
from .linear import sigmoid

THRESHOLD = 0.3
STEMS = (4, 5)


@dataclass(frozen=True)
class Params:
    sample_rows: int = 10_000
    rank: int = 4
    warm: int = 10
    stage: int = 5
    penalties: tuple[float, ...] = (10.0, 1.0, 0.1)
    batch: int = 128
    rate: float = 0.2
    rate_v: float = 0.05
    spread: float = 0.02
    l1: float = 1e-3
    min_df: int = 4
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    terms: np.ndarray  # sorted 64-bit hashes
    bias: float
    w: np.ndarray
    v: np.ndarray
    usable: bool = True

    def score(self, d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from their distinct (text, term) pairs."""
        if len(self.terms) == 0:
            return np.full(n, sigmoid(np.array(self.bias)))
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        d, at = d[known], at[known]
        return sigmoid(_raw(self.bias, self.w, self.v, d, at, n)[0])


def _raw(b, w, v, d, at, n):
    z = b + K.per_text(np.add, w[at], d, n)
    s = K.per_text(np.add, v[at], d, n)
    q = K.per_text(np.add, v[at] ** 2, d, n)
    return z + 0.5 * (s * s - q).sum(axis=1), s


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term): each word and its first 4 and 5 bytes, so that
    inflected forms of one stem share a term."""
    h, d, s, e = K.words(data, offs, K.ALNUM)
    ds, hs, low = [d], [h], K.LOWER[data]
    for n in STEMS:
        at = np.flatnonzero(e - s > n)
        ds.append(d[at])
        hs.append(K.mix(K.span_hash(low, s[at], s[at] + n), n))
    d, h, _ = K.unique_pairs(np.concatenate(ds), np.concatenate(hs))
    return d, h


def numbers(vocab: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place in the vocabulary of the terms of all texts, number of terms of each text)."""
    ats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo, hi, data, offs in K.chunks(texts):
        d, h = terms(data, offs)
        at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0)).astype(np.int32)
        known = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
        ats.append(at[known])
        sizes.append(np.bincount(d[known], minlength=hi - lo))
    return np.concatenate(ats), np.concatenate(sizes)


def fit(texts: pa.Array, y: np.ndarray, p: Params = Params()) -> Machine:
    """Fit on texts in memory; ``train`` does the same from tables."""
    hs = [np.zeros(0, K.U64), *(terms(data, offs)[1] for _, _, data, offs in K.chunks(texts))]
    vocab, df = np.unique(np.concatenate(hs), return_counts=True)
    vocab, df = vocab[df >= p.min_df], df[df >= p.min_df]
    return learn(vocab, df, *numbers(vocab, texts), y, p)


def learn(vocab: np.ndarray, df: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray, p: Params) -> Machine:
    """The machine from the vocabulary, the sample rows that have each term, and the
    rows' terms (``numbers``)."""
    rate = (y.sum() + 1) / (len(y) + 2)
    low = min(rate, THRESHOLD / 2)          # nothing learnt: nothing is predicted
    none = Machine(np.zeros(0, K.U64), float(np.log(low / (1 - low))), np.zeros(0), np.zeros((0, p.rank)),
                   usable=False)
    if len(y) == 0 or y.min() == y.max() or len(vocab) == 0:
        return none
    bounds = np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(p.seed)
    w, v = np.zeros(len(vocab)), np.zeros((len(vocab), p.rank))
    gw, gv = np.full(len(vocab), 1e-2), np.full(v.shape, 1e-6)
    b, gb = none.bias, 1.0
    for shrink in [None] * p.warm + [x for x in p.penalties for _ in range(p.stage)]:
        if shrink is not None and not v.any():
            v = rng.normal(0, p.spread, v.shape)
        perm = rng.permutation(len(y))
        for lo in range(0, len(y), p.batch):
            rows = np.sort(perm[lo:lo + p.batch])
            size = bounds[rows + 1] - bounds[rows]
            dd = np.repeat(np.arange(len(rows)), size)
            flat = np.repeat(bounds[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ids = at[flat]
            if shrink is None:
                z = b + K.per_text(np.add, w[ids], dd, len(rows))
            else:
                z, s = _raw(b, w, v, dd, ids, len(rows))
            g = (sigmoid(z) - y[rows]) / len(rows)
            gb += g.sum() ** 2
            b -= p.rate * g.sum() / np.sqrt(gb)
            u, k = np.unique(ids, return_inverse=True)
            dw = np.bincount(k, weights=g[dd], minlength=len(u))
            gw[u] += dw ** 2
            step = p.rate / np.sqrt(gw[u])
            x = w[u] - step * dw
            w[u] = np.sign(x) * np.maximum(np.abs(x) - step * p.l1, 0)
            if shrink is None:
                continue
            near = g[dd, None] * (s[dd] - v[ids])
            dv = np.stack([np.bincount(k, weights=near[:, f], minlength=len(u)) for f in range(p.rank)], axis=1)
            gv[u] += dv ** 2
            step = p.rate_v / np.sqrt(gv[u])
            v[u] = (v[u] - step * dv) / (1 + step * shrink / df[u][:, None])
    return Machine(vocab, float(b), w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where=None,
          p: Params = Params()) -> Machine:
    """``where``: the label rows that may be learnt from."""
    sample = keep(labelled_sample(docs, labels, label, p.sample_rows, where).select("key", "y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(0)):
                u, c = np.unique(terms(data, offs)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(u)), pa.array(c)], names=["term", "c"])

    found = (sample.select("text").mapInArrow(count, "term long, c long").groupBy("term").agg(F.sum("c").alias("c"))
             .filter(F.col("c") >= p.min_df).toArrow())  # at most 1 / min_df of the sample's terms
    vocab, df = found["term"].to_numpy().view(K.U64), found["c"].to_numpy()
    order = np.argsort(vocab)
    vocab, df = vocab[order], df[order]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), K.int_list(*numbers(vocab, b.column(2)), pa.int32())],
                                             names=["key", "y", "at"])

    like = sample.select("key", "y").limit(0).withColumn("at", F.array().cast("array<int>"))
    rows = sample.mapInArrow(look_up, like.schema).orderBy("key").toArrow()
    y, lists = rows["y"].to_numpy().astype(float), rows["at"].chunks
    at = np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in lists)])
    size = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in lists)])
    del rows, lists, found
    release()
    model = learn(vocab, df, at, size, y, p)
    del at, size
    release()
    return model


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a probability ``out``; all other columns are kept."""
    cols = [c for c in docs.columns if c != out]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    i = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for lo, hi, data, offs in K.chunks(b.column(i)):
                s[lo:hi] = machine.score(*terms(data, offs), hi - lo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.limit(0).withColumn(out, F.lit(0.0)).schema)


def toxic(machine: Machine, score: str = "score") -> Column:
    """Is the score at or above the threshold?  Never by a machine that is not usable."""
    return F.lit(machine.usable) & (F.col(score) >= THRESHOLD)


def op3(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of fold 2 unseen."""
    machine = train(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, p)
    s = score(docs.select("doc_id", "text"), machine)
    return s.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
