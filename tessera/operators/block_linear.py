"""Logistic regressions and linear SVMs of all blocks, by Newton steps taken together.

A step gives every chunk its block's coefficients; the chunk returns the loss,
gradient and Hessian of its rows (sums, whose size depends on the number of
features alone), Spark adds them by (block, entry), and each block solves its own
small system.  A step is one job for all blocks; a block that fits one chunk takes
all its steps in one job.  A block whose loss rose goes back half the way.

* ``LR``: two classes share one logit; more classes have a softmax, whose
  Hessian is bounded by twice its blocks on the diagonal, hence half steps.
* ``SVM``: squared hinge loss, one machine a class where there are more than two.

A block of one class learns a model that predicts it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK
from tessera.operators.lockstep import CHUNK_ROWS, Dealt, checkpointed, cogrouped, deal, matrix

#: share of the mean of the Hessian's diagonal that is added to it
RIDGE = 1e-9


@dataclass(frozen=True)
class LinearSettings:
    algo: str                 # LR or SVM
    steps: int = 50           # MLlib's maxIter of the reference's learners
    reg: float = 0.0          # on the mean loss, intercepts free
    tol: float = 1e-6         # relative gain of the loss at which a block stops

    @staticmethod
    def of(algo: str, maxIter: int = 50, regParam: float = 0.0, tol: float = 1e-6) -> LinearSettings:  # noqa: N803 - MLlib's names
        return LinearSettings(algo, maxIter, regParam, tol)


def _heads(n_classes: int) -> int:
    return 1 if n_classes == 2 else n_classes


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(s: LinearSettings, x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradients and upper triangles of the Hessians of some rows, in one array."""
    heads, d = theta.shape
    one = _with_one(x)
    f = one @ theta.T
    want = (y[:, None] == (1 if heads == 1 else np.arange(heads))).astype(float)
    if s.algo == "LR" and heads == 1:
        loss = np.logaddexp(0, f).sum() - (f * want).sum()
        p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        slope, curve = p - want, p * (1 - p)
    elif s.algo == "LR":
        top = f.max(axis=1, keepdims=True)
        e = np.exp(f - top)
        p = e / e.sum(axis=1, keepdims=True)
        loss = (np.log(e.sum(axis=1)) + top[:, 0]).sum() - (f * want).sum()
        slope, curve = p - want, 2 * p * (1 - p)
    else:
        sign = 2 * want - 1
        short = np.maximum(0, 1 - sign * f)
        loss, slope, curve = (short ** 2).sum(), -2 * sign * short, 2.0 * (short > 0)
    upper = np.triu_indices(d)
    hessians = [((one * curve[:, [k]]).T @ one)[upper] for k in range(heads)]
    return np.concatenate([[float(len(x)), loss], (slope.T @ one).ravel(), *hessians])


def _solve(s: LinearSettings, theta: np.ndarray, best: np.ndarray, low: float, sums: np.ndarray):
    """(next coefficients, best so far, their loss, done?) from the sums at ``theta``."""
    heads, d = theta.shape
    n, loss = sums[0], sums[1]
    free = np.ones(d)
    free[-1] = 0
    loss += s.reg * n / 2 * float((theta[:, :-1] ** 2).sum())
    if not np.isfinite(loss) or loss > low + 1e-12 * abs(low):
        return (theta + best) / 2, best, low, bool(np.abs(theta - best).max() < 1e-12)
    g = sums[2:2 + heads * d].reshape(heads, d) + s.reg * n * theta * free
    new, at = theta.copy(), 2 + heads * d
    upper, size = np.triu_indices(d), d * (d + 1) // 2
    for k in range(heads):
        h = np.zeros((d, d))
        h[upper] = sums[at + k * size:at + (k + 1) * size]
        h = h + np.triu(h, 1).T + np.diag(s.reg * n * free)
        h[np.diag_indices(d)] += RIDGE * max(np.trace(h) / d, 1e-3)
        new[k] -= np.linalg.lstsq(h, g[k], rcond=None)[0]
    return new, theta, loss, bool(np.isfinite(low) and low - loss <= s.tol * abs(loss)) or loss <= s.tol * n


@dataclass
class Planes:
    """The linear models of all blocks: ``theta`` (block, coefficients by class)."""

    theta: DataFrame
    accuracy: DataFrame | None
    settings: LinearSettings
    n_classes: int
    n_features: int
    col: str = BLOCK

    @property
    def row_bytes(self) -> int:
        return 8 * _heads(self.n_classes) * (self.n_features + 1)

    def table(self) -> DataFrame:
        return self.theta.withColumnRenamed(self.col, "model_id")

    def keep(self, kept: DataFrame) -> Planes:
        return replace(self, theta=self.theta.join(kept.select(F.col("model_id").alias(self.col)), self.col, "left_semi"))

    def summary(self) -> DataFrame:
        """``model_id, loss, steps``."""
        return self.table().select("model_id", "loss", "steps")

    def scorer(self, table: pa.Table):
        """x -> (rows, models) class numbers, for the models of a collected part."""
        order = np.argsort(table["model_id"].to_numpy())
        theta = matrix(table["best"])[order].reshape(len(order), _heads(self.n_classes), -1)
        return lambda x: _classes(theta, x)


def _classes(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    f = np.einsum("nd,mkd->nmk", _with_one(x), theta)
    return (f[:, :, 0] > 0).astype(np.int64) if theta.shape[1] == 1 else f.argmax(axis=2)


def fit_planes(rows: DataFrame, s: LinearSettings, n_features: int, n_classes: int, order: str = "row_id",
               col: str = BLOCK, chunk_rows: int = CHUNK_ROWS) -> Planes:
    """Linear models of all blocks from rows (block, row id, y 0..n_classes-1,
    role, features); rows of role ``validate`` only measure the accuracy of their
    own block's model."""
    heads, d = _heads(n_classes), n_features + 1
    dealt = deal(rows.select(col, F.xxhash64(order).alias("row"), "y", "role", "features"), "row", col, chunk_rows)
    train = dealt.only("train")

    def chunk(part: pa.Table, state: pa.Table) -> pa.Table:
        if len(part) and len(state) and not state["done"][0].as_py():
            v = _sums(s, matrix(part["features"]), part["y"].to_numpy(), matrix(state["theta"]).reshape(heads, d))
            block = part[col][0].as_py()
        else:
            v, block = np.zeros(0), 0
        return pa.table({col: pa.array(np.full(len(v), block), pa.int32()),
                         "at": pa.array(np.arange(len(v)), pa.int32()), "v": pa.array(v, pa.float64())})

    def as_row(block, theta, best, loss, steps, done) -> pa.Table:
        return pa.table({col: block, "theta": [theta.ravel().tolist()], "best": [best.ravel().tolist()],
                         "loss": [loss], "steps": pa.array([steps], pa.int32()), "done": [done]})

    def solve(state: pa.Table, sums: pa.Table) -> pa.Table:
        if not len(sums) or not len(state):
            return state
        v = np.zeros(2 + heads * d + heads * d * (d + 1) // 2)
        v[sums["at"].to_numpy()] = sums["v"].to_numpy()
        theta, best = (np.array(state[c][0].as_py()).reshape(heads, d) for c in ("theta", "best"))
        new, best, loss, done = _solve(s, theta, best, state["loss"][0].as_py(), v)
        return as_row(state[col], new, best, loss, state["steps"][0].as_py() + 1, done)

    def whole_block(part: pa.Table, state: pa.Table) -> pa.Table:
        new = best = np.zeros((heads, d))
        loss, steps, done = float("inf"), 0, False
        if len(part) and len(state):
            x, y = matrix(part["features"]), part["y"].to_numpy()
            while steps < s.steps and not done:
                new, best, loss, done = _solve(s, new, best, loss, _sums(s, x, y, new))
                steps += 1
        return as_row(state[col], new, best, loss, steps, done) if steps else as_row(state[col], new, best, loss, 0, True).slice(0, 0)

    zero = F.array_repeat(F.lit(0.0), heads * d)
    kind = f"{col} int, theta array<double>, best array<double>, loss double, steps int, done boolean"
    start = checkpointed(rows.filter("role = 'train'").select(col).distinct().select(
        col, zero.alias("theta"), zero.alias("best"), F.lit(float("inf")).alias("loss"), F.lit(0).alias("steps"), F.lit(False).alias("done")))
    whole, large = train.split()
    found = checkpointed(whole.step(start.select(col), whole_block, kind))
    if large.any():
        state = start.join(F.broadcast(large.sizes.select(col)), col, "left_semi")
        for _ in range(s.steps):
            sums = large.step(state, chunk, f"{col} int, at int, v double").groupBy(col, "at").agg(F.sum("v").alias("v"))
            state = checkpointed(cogrouped(state, sums, solve, kind, col))
            if not state.filter("not done").limit(1).count():
                break
        found = checkpointed(found.unionByName(state))
    state = found
    accuracy = _own_accuracy(dealt.only("validate"), state, heads, d)
    dealt.release()
    return Planes(state.select(col, "best", "loss", "steps"), accuracy, s, n_classes, n_features, col)


def _own_accuracy(validate: Dealt, state: DataFrame, heads: int, d: int) -> DataFrame:
    """C2 for all blocks in one job: ``model_id, n_validate, accuracy``."""
    col = validate.col

    def judge(rows: pa.Table, st: pa.Table) -> pa.Table:
        hit = 0
        if len(rows) and len(st):
            theta = matrix(st["best"]).reshape(1, heads, d)
            hit = int((_classes(theta, matrix(rows["features"]))[:, 0] == rows["y"].to_numpy()).sum())
        some = rows if len(rows) else st
        return pa.table({col: pa.array([some[col][0].as_py()], pa.int32()), "n": [len(rows)], "hit": [hit]})

    got = validate.step(state, judge, f"{col} int, n long, hit long").groupBy(col).agg(F.sum("n").alias("n_validate"), F.sum("hit").alias("_h"))
    return checkpointed(got.select(F.col(col).alias("model_id"), "n_validate", F.try_divide(F.col("_h"), F.col("n_validate")).alias("accuracy")))
