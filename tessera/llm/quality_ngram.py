"""Quality rules: fixed limits on whole-text counts, then a calibrated
logistic regression over hashed word and character n-grams.

The regression is fitted on a bounded sample of labelled rows
(``sample_rows``, a documented bound): four fifths of the sample train it, the
rest calibrate its probability (Platt scaling).  Counts and scores of every
whole text are made in Arrow batches; the limits are constants, alike at
every size.

Null and empty texts have no words: all counts 0, ``base_failed`` (fewer than
``min_words`` words).  Repeated rows give one result each, null ids pass
through, an empty table gives an empty result.  A sample without both classes
leaves the rules alone: the probability is then the label rate and documents
that pass the rules are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import collect_sample, labelled_sample, release
from .grams import Grams
from .linear import adam, platt, sigmoid


@dataclass(frozen=True)
class Params:
    sample_rows: int = 6_000
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    min_probability: float = 0.3
    l2: float = 1e-4
    steps: int = 150
    grams: Grams = Grams(bits=14, orders=(3,))


@dataclass(frozen=True)
class Model:
    grams: Grams
    weights: np.ndarray
    a: float
    b: float
    usable: bool

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.grams.score(self.weights, data, offs) + self.b)


def fit(texts: pa.Array, y: np.ndarray, keys: np.ndarray, p: Params = Params()) -> Model:
    """Logistic regression on the rows whose key hash is not 0 mod 5, Platt
    scaling on the others (on all rows where either side lacks a class)."""
    if len(y) == 0 or y.min() == y.max():
        a, b = platt(np.zeros(len(y)), y)
        return Model(p.grams, np.zeros(p.grams.dim), a, b, False)
    x = p.grams.rows(texts)
    held = K.mix(np.asarray(keys, dtype=np.int64).view(K.U64)) % K.U64(5) == 0
    both = lambda m: m.any() and y[m].min() != y[m].max()
    if not (both(held) and both(~held)):
        held = np.zeros(len(y), bool)
    use = (~held).astype(float)
    use /= use.sum()

    def grad(w):
        g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * use
        return np.append(x.t_dot(g) + p.l2 * w[:-1], g.sum())

    w = adam(grad, np.zeros(x.dim + 1), p.steps)
    at = held if held.any() else ~held
    a, b = platt(x.dot(w[:-1])[at], y[at])
    return Model(p.grams, w[:-1].astype(np.float32), a, b, True)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where=None, p: Params = Params()) -> Model:
    texts, y, keys = collect_sample(labelled_sample(docs, labels, label, p.sample_rows, where))
    model = fit(texts, y, keys, p)
    del texts
    release()
    return model


SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: the first byte of each UTF-8 code point
LEAD = (np.arange(256) & 0xC0) != 0x80


def counts(data: np.ndarray, offs: np.ndarray, k: int = 5) -> dict[str, np.ndarray]:
    """Whole-text counts of each text of a chunk."""
    n = len(offs) - 1
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    s, e, d = K.runs(K.SOLID[data], offs)
    out = {"n_words": np.bincount(d, minlength=n) if n else np.zeros(0, np.int64),
           "word_chars": total(LEAD[data] & K.SOLID[data]), "n_symbols": total(SYMBOL[data])}
    # lines with a word, equal to an earlier line of the same text
    ls, le, ld = K.runs(data != 10, offs)
    has = np.searchsorted(s, ls, side="left") < np.searchsorted(s, le, side="left")
    ls, le, ld = ls[has], le[has], ld[has]
    dd, _, c = K.unique_pairs(ld, K.span_hash(data, ls, le))
    out["n_dup_lines"] = np.bincount(dd, weights=c - 1, minlength=n).astype(np.int64)
    # words inside k-word windows that occur twice or more in the text
    h = K.span_hash(data, s, e)
    w, at = K.window_hash(h, d, k)
    order = np.lexsort((w, d[at]))
    ws, ds = w[order], d[at][order]
    same = np.zeros(len(ws) + 1, dtype=bool)
    same[1:-1] = (ws[1:] == ws[:-1]) & (ds[1:] == ds[:-1])
    hit = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(d[covered], minlength=n)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*((c, "bigint") for c in COUNTS), ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")]


def judge(docs: DataFrame, model: Model, p: Params = Params(), text: str = "text") -> DataFrame:
    """docs with the counts, ``base_failed``, ``probability`` and ``kept``;
    input columns of those names are replaced."""
    names = [n for n, _ in ADDED]
    cols = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    i = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cs = {c: np.zeros(b.num_rows, np.int64) for c in COUNTS}
            prob = np.zeros(b.num_rows)
            for lo, hi, data, offs in K.chunks(b.column(i)):
                for c, x in counts(data, offs, p.window).items():
                    cs[c][lo:hi] = x
                prob[lo:hi] = model.probability(data, offs)
            failed = (cs["n_words"] < p.min_words) | (100 * cs["n_repeat_words"] > p.max_repeat_pct * cs["n_words"])
            good = prob >= p.min_probability if model.usable else np.ones(b.num_rows, bool)
            more = [*(pa.array(cs[c]) for c in COUNTS), pa.array(failed), pa.array(prob), pa.array(~failed & good)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    like = docs.limit(0).select("*", *[F.lit(None).cast(k).alias(n) for n, k in ADDED])
    return docs.mapInArrow(run, like.schema)


def op4(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept and the probability."""
    out = judge(docs.select("doc_id", "text"), train(docs, labels, "quality", None, p), p)
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "probability")
