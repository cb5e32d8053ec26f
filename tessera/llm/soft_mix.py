"""Mixing sources to target weights with soft memberships.

A softmax classifier over hashed n-gram frequencies, fitted on a bounded
sample of a labelled table (doc_id, domain), predicts the domain posterior
p_ik of every whole text.  With t_i the words of a document, the rates r_i >= 0
solve

    min  1/2 sum_k ( sum_i t_i p_ik r_i / S - T_k )^2,   S = sum_i t_i

by accelerated projected gradient from r = 1: T_k are the target shares of
all tokens.  A step moves r_i by p_i . residual (the gradient in the token
weighted metric) and cuts at 0; the step size is 1 / L with L the largest
eigenvalue of sum_i t_i p_i p_i' / S, from one pass.  Documents stay where they
are: each iteration is a narrow update and one aggregate of K sums, and only
those K sums reach the driver.  The iterations run on (tokens, posterior)
without the texts, checkpointed every ``cut`` iterations.  A rate depends on
the row's posterior and the K residuals of each step alone, so the texts get
theirs by replaying the steps in a last scan.  It stops when no share is off by more than ``tolerance`` and
reports the reached shares; ``max_steps`` bounds the passes.

Null and empty texts have no tokens: rate 1, no weight.  Rows of null domain
or id teach nothing; a document labelled twice counts with its smallest domain.
Targets of domains without any posterior mass cannot be met; the fit is then
the least-squares one.  Repeated rows are documents of their own; an empty
table gives an empty result; without labelled rows the posteriors are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import keep, release
from .grams import Grams
from .linear import Rows, adam


@dataclass(frozen=True)
class Params:
    sample_rows: int = 3_000
    l2: float = 1e-4
    steps: int = 80
    tolerance: float = 1e-4
    max_steps: int = 60
    cut: int = 10
    grams: Grams = Grams(bits=12, orders=(3,))


@dataclass(frozen=True)
class Domains:
    names: tuple[str, ...]
    grams: Grams
    weights: np.ndarray  # dim x K
    bias: np.ndarray

    def posterior(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.grams.score(self.weights, data, offs) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: pa.Array, domain: list[str], names: tuple[str, ...], p: Params = Params()) -> Domains:
    """Fit on texts in memory; ``train`` does the same from tables."""
    return learn(p.grams.rows(texts), domain, names, p)


def learn(x: Rows, domain: list[str], names: tuple[str, ...], p: Params) -> Domains:
    k, dim = len(names), p.grams.dim
    if len(domain) == 0:
        return Domains(names, p.grams, np.zeros((dim, k), np.float32), np.zeros(k))
    y = np.zeros((len(domain), k))
    y[np.arange(len(domain)), [names.index(d) for d in domain]] = 1

    def grad(w: np.ndarray) -> np.ndarray:
        w = w.reshape(dim + 1, k)
        z = np.stack([x.dot(w[:-1, j]) for j in range(k)], axis=1) + w[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = (z / z.sum(axis=1, keepdims=True) - y) / len(y)
        body = np.stack([x.t_dot(g[:, j]) for j in range(k)], axis=1) + p.l2 * w[:-1]
        return np.vstack([body, g.sum(axis=0)]).reshape(-1)

    w = adam(grad, np.zeros((dim + 1) * k), p.steps).reshape(dim + 1, k)
    return Domains(names, p.grams, w[:-1].astype(np.float32), w[-1])


def train(docs: DataFrame, table: DataFrame, names: tuple[str, ...], p: Params = Params()) -> Domains:
    """``table`` (doc_id, domain); ``names`` are the domains of the targets."""
    some = (table.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*names))
            .groupBy(F.col("doc_id").alias("_k")).agg(F.min("domain").alias("domain"))
            .orderBy(F.xxhash64("_k", F.lit("sample")), "_k").limit(p.sample_rows))
    texts = (docs.select(F.col("doc_id").alias("_k"), F.col("text").alias("_t"))
             .join(F.broadcast(some), "_k")  # at most sample_rows rows
             .groupBy("_k", "domain").agg(F.min("_t").alias("text")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = p.grams.rows(b.column(2))
            size = np.bincount(x.row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), K.int_list(x.ids, size, pa.int32()), K.int_list(x.values, size, pa.float32())],
                names=["_k", "domain", "ids", "vals"])

    # the tasks make the features, so the driver holds no texts
    like = texts.select("_k", "domain").limit(0).withColumn("ids", F.array().cast("array<int>")).withColumn(
        "vals", F.array().cast("array<float>"))
    rows = texts.mapInArrow(features, like.schema).orderBy("_k").toArrow()
    flat = {c: np.concatenate([np.zeros(0, t), *(x.flatten().to_numpy() for x in rows[c].chunks)])
            for c, t in (("ids", np.int32), ("vals", np.float32))}
    size = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in rows["ids"].chunks)])
    domain = rows["domain"].to_pylist()
    del rows
    release()
    model = learn(Rows(flat["ids"], flat["vals"], size, p.grams.dim), domain, names, p)
    del flat
    release()
    return model


def memberships(docs: DataFrame, model: Domains, text: bool = False, moves: list | None = None) -> DataFrame:
    """docs with ``tokens`` and the array ``posterior``, without the text unless
    ``text``; with ``moves`` also the ``rate`` that these steps lead to."""
    new = {"tokens": "bigint", "posterior": "array<double>", **({} if moves is None else {"rate": "double"})}
    cols = [c for c in docs.columns if c not in (*new, "text")] + ["text"]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    k, old = len(model.names), len(cols) - (not text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, post = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, k))
            for lo, hi, data, offs in K.chunks(b.column(len(cols) - 1)):
                _, _, d = K.runs(K.SOLID[data], offs)
                tokens[lo:hi] = np.bincount(d, minlength=hi - lo)
                post[lo:hi] = model.posterior(data, offs)
            more = [pa.array(tokens), K.int_list(post.reshape(-1), np.full(b.num_rows, k), pa.float64())]
            if moves is not None:
                more.append(pa.array(np.where(tokens > 0, replay(post, moves), 1.0)))
            yield pa.RecordBatch.from_arrays([*b.columns[:old], *more], names=[*b.schema.names[:old], *new])

    like = docs.select(*cols[:old]).limit(0).select("*", *[F.lit(None).cast(t).alias(n) for n, t in new.items()])
    return docs.mapInArrow(run, like.schema)


def replay(post: np.ndarray, moves: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The rates of rows with these posteriors after the given steps."""
    r = y = np.ones(len(post))
    for move, beta in moves:
        new = np.maximum(0, y - post @ move)
        y, r = new + beta * (new - r), new
    return r


@dataclass(frozen=True)
class Mix:
    rows: DataFrame  # the input with ``rate``
    shares: dict[str, float]  # reached shares
    moves: list[tuple[np.ndarray, float]]  # of each step: its move by domain and its extrapolation


def rates(rows: DataFrame, targets: dict[str, float], names: tuple[str, ...], p: Params = Params()) -> Mix:
    """``rows`` has tokens and posterior (in the order of ``names``)."""
    k = len(names)
    want = np.array([targets[n] for n in names], float)
    want = want / want.sum()
    at = [F.element_at("posterior", j + 1) for j in range(k)]
    t = F.col("tokens").cast("double")
    first = rows.agg(F.sum(t), *[F.sum(t * at[i] * at[j]) for i in range(k) for j in range(i, k)],
                     *[F.sum(t * at[i]) for i in range(k)]).first()
    total = first[0] or 0.0
    if not total:
        return Mix(rows.withColumn("rate", F.lit(1.0)), {n: 0.0 for n in names}, [])
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = [x / total for x in first[1:1 + k * (k + 1) // 2]]
    m = m + m.T - np.diag(np.diag(m))
    size = 1.0 / max(np.linalg.eigvalsh(m)[-1], 1e-12)
    share = np.array([x / total for x in first[-k:]])
    # rate: the last iterate; y: the extrapolated point, at which ``at_y`` holds the shares
    now = rows.withColumn("rate", F.lit(1.0)).withColumn("_y", F.lit(1.0))
    at_y, last, theta, moves = share.copy(), share.copy(), 1.0, []
    while np.abs(last - want).max() > p.tolerance and len(moves) < p.max_steps:
        g = at_y - want
        move = F.lit(0.0)
        for j in range(k):
            move = move + float(size * g[j]) * at[j]
        new = F.greatest(F.lit(0.0), F.col("_y") - move)
        theta2 = (1 + np.sqrt(1 + 4 * theta * theta)) / 2
        beta = (theta - 1) / theta2
        moves.append((size * g, beta))
        now = now.withColumn("_n", new).withColumn("_y", F.col("_n") + beta * (F.col("_n") - F.col("rate")))
        now = now.drop("rate").withColumnRenamed("_n", "rate")
        if len(moves) % p.cut == 0:
            now = keep(now)
        got = now.agg(*[F.sum(t * a * F.col("rate")) for a in at], *[F.sum(t * a * F.col("_y")) for a in at]).first()
        last, at_y = np.array(got[:k], float) / total, np.array(got[k:], float) / total
        theta = theta2
    return Mix(now.drop("_y"), dict(zip(names, map(float, last), strict=True)), moves)


def fitted(docs: DataFrame, table: DataFrame, targets: dict[str, float], p: Params = Params()) -> tuple[Domains, Mix]:
    """The classifier, and the rates of (doc_id, tokens, posterior) of all documents."""
    names = tuple(sorted(targets))
    model = train(docs, table, names, p)
    m = rates(keep(memberships(docs.select("doc_id", "text"), model)), targets, names, p)
    return model, Mix(m.rows.withColumn("rate", F.when(F.col("tokens") > 0, F.col("rate")).otherwise(1.0)), m.shares, m.moves)


def mix(docs: DataFrame, table: DataFrame, targets: dict[str, float], p: Params = Params()) -> DataFrame:
    """docs with tokens, posterior and rate (rows without tokens: rate 1)."""
    model, m = fitted(docs, table, targets, p)
    return memberships(docs, model, text=True, moves=m.moves)


#: the shares of tokens that the query and the pipeline ask for
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def domain_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents: their language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(
        labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op7(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, tokens, the posteriors by domain, and the rate of every document."""
    _, m = fitted(docs, domain_table(docs, labels), TARGETS, p)
    names = sorted(TARGETS)
    return m.rows.select("doc_id", "tokens", *[F.element_at("posterior", j + 1).alias(f"p_{n}") for j, n in enumerate(names)],
                         "rate")
