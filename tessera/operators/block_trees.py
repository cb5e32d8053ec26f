"""Decision trees and forests of all blocks, grown level by level together.

* Bins: one aggregate gives every (block, feature) its quantiles; a cut lies
  halfway between two of them.  Rows are kept as one byte a feature.
* Level: every chunk routes its rows through the trees so far and counts them by
  (block, tree, node, feature, bin, class); Spark adds the counts, a window
  runs over the bins, and the best cut by Gini impurity of each node becomes
  two children.  A level is one job for all blocks and all trees.
* Forests: Poisson(1) row weights and a feature subset for each node, both by
  hashes, so a fit is repeatable at every partitioning.

The model is a table (block, tree, node, ...): trees of 8,000 blocks are never on
the driver.  A forest predicts the class that most of its trees predict
(ties: the smallest).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK
from tessera.operators.lockstep import CHUNK_ROWS, Dealt, checkpointed, deal, matrix, mixed

#: cumulative probabilities of Poisson(1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
NODES = ("{col} int, tree int, node long, level int, pred int, feature int, cutbin int, lpred int, rpred int, "
         "lopen boolean, ropen boolean")
#: counters of a chunk that are kept flat whatever the number of its rows
DENSE = 1 << 16


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 1
    max_depth: int = 20
    max_bins: int = 32
    min_rows: int = 1
    subset: int | None = None      # features tried at a node; None: all
    bootstrap: bool = False
    seed: int = 0

    @staticmethod
    def of(algo: str, n_features: int, seed: int = 0, numTrees: int = 40, maxDepth: int = 20,  # noqa: N803 - MLlib's names
           maxBins: int = 32, minInstancesPerNode: int = 1) -> TreeSettings:  # noqa: N803
        if algo == "DT":
            return TreeSettings(1, maxDepth, maxBins, minInstancesPerNode, seed=seed)
        return TreeSettings(numTrees, maxDepth, maxBins, minInstancesPerNode,
                            max(1, math.ceil(math.sqrt(n_features))), numTrees > 1, seed)


def cuts_by_block(rows: DataFrame, n_features: int, max_bins: int, col: str = BLOCK) -> DataFrame:
    """(block, cuts ARRAY<ARRAY<DOUBLE>>): at most ``max_bins - 1`` ascending cuts a feature."""
    at = [i / (max_bins - 1) for i in range(max_bins)]
    points = f"array({', '.join(f'{p}D' for p in at)})"
    found = rows.groupBy(col).agg(F.expr("array({})".format(", ".join(
        f"array_distinct(percentile_approx(features[{i}], {points}, 1000))" for i in range(n_features)))).alias("q"))
    n = "greatest(size(q) - 1, 0)"
    return found.selectExpr(col, f"transform(q, q -> zip_with(slice(q, 1, {n}), slice(q, 2, {n}), (a, b) -> a + (b - a) / 2)) AS cuts")


#: what a binned row keeps
_BINNED = ("row", "y", "role")


def _bin(rows: pa.Table, state: pa.Table, col: str) -> pa.Table:
    x = matrix(rows["features"])
    if not len(state):                          # a block without a row to train on
        return pa.table({**{c: rows[c].slice(0, 0) for c in (*_BINNED, col)}, "bins": pa.array([], pa.binary())})
    cuts = state["cuts"][0].as_py()
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(np.array(c, float), x[:, f], side="left")
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(out)])
    return pa.table({**{c: rows[c] for c in _BINNED}, col: rows[col], "bins": packed.cast(pa.binary())})


def _codes(table: pa.Table, d: int) -> np.ndarray:
    flat = table["bins"].combine_chunks().cast(pa.large_binary())
    return np.frombuffer(flat.buffers()[2], np.uint8)[flat.offset * d:(flat.offset + len(flat)) * d].reshape(-1, d)


def _nodes(state: pa.Table, cut: str) -> dict[str, np.ndarray]:
    """The nodes of one model sorted by their key tree * 2^32 + node."""
    get = {c: state[c].to_numpy() for c in ("tree", "node", "pred", "lpred", "rpred")}
    key = (get["tree"].astype(np.int64) << 32) | get["node"].astype(np.int64)
    order = np.argsort(key)
    out = {c: v[order] for c, v in get.items()}
    out["feature"] = state["feature"].fill_null(-1).to_numpy()[order]
    out["cut"] = state[cut].fill_null(0).to_numpy()[order]
    return out | {"key": key[order]}


def _walk(nodes: dict[str, np.ndarray], x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, predicted class) that every row of x reaches in a tree."""
    base = np.int64(tree) << 32
    cur = np.full(len(x), base + 1)
    root = np.searchsorted(nodes["key"], base + 1)
    pred = np.full(len(x), nodes["pred"][root] if root < len(nodes["key"]) and nodes["key"][root] == base + 1 else 0)
    live = np.arange(len(x))
    while len(live):
        at = np.searchsorted(nodes["key"], cur[live])
        at[at == len(nodes["key"])] = 0
        on = (nodes["key"][at] == cur[live]) & (nodes["feature"][at] >= 0)
        live, at = live[on], at[on]
        right = x[live, nodes["feature"][at]] > nodes["cut"][at]
        cur[live] = base + 2 * (cur[live] - base) + right
        pred[live] = np.where(right, nodes["rpred"][at], nodes["lpred"][at])
    return cur - base, pred


def _forest(nodes: dict[str, np.ndarray], x: np.ndarray, trees: int, n_classes: int) -> np.ndarray:
    votes = np.zeros((len(x), n_classes), np.int32)
    for t in np.intersect1d(np.arange(trees), nodes["tree"]):       # a tree that drew no row has no say
        votes[np.arange(len(x)), _walk(nodes, x, int(t))[1]] += 1
    return votes.argmax(axis=1)


def _tried(s: TreeSettings, d: int, block: int, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features (ascending) tried at each node."""
    m = min(s.subset or d, d)
    if m == d:
        return np.tile(np.arange(d), (len(nodes), 1))
    rank = mixed(np.arange(d)[None, :], s.seed, block, tree, nodes[:, None])
    return np.sort(np.argsort(rank, axis=1, kind="stable")[:, :m], axis=1)


def _weights(s: TreeSettings, h: np.ndarray, tree: int) -> np.ndarray:
    if not s.bootstrap:
        return np.ones(len(h))
    return np.searchsorted(_POISSON, mixed(h, s.seed, tree) / 2.0**64, side="right").astype(float)


def _counts(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, tried: np.ndarray, bins: int, n_classes: int):
    """(node number, feature, bin, rows by class), in this order, of rows that lie
    in the node number ``at``."""
    m = tried.shape[1]
    cell = (at[:, None] * m + np.arange(m)) * bins + x[np.arange(len(x))[:, None], tried[at]]
    cell = (cell * n_classes + y[:, None]).ravel()
    size = len(tried) * m * bins
    if size * n_classes <= 4 * len(cell) + DENSE:
        n = np.bincount(cell, weights=np.repeat(w, m), minlength=size * n_classes).reshape(-1, n_classes)
        hit = np.flatnonzero(n.any(axis=1))
        n = n[hit]
    else:
        known, of = np.unique(cell, return_inverse=True)
        hit, row = np.unique(known // n_classes, return_inverse=True)
        n = np.zeros((len(hit), n_classes))
        n[row, known % n_classes] = np.bincount(of, weights=np.repeat(w, m))
        some = n.any(axis=1)
        hit, n = hit[some], n[some]
    node = hit // (m * bins)
    return node, tried[node, hit // bins % m], hit % bins, n


def _counter(s: TreeSettings, d: int, n_classes: int, col: str):
    """The step function of a level: counts of the rows in open nodes."""

    def count(rows: pa.Table, state: pa.Table) -> pa.Table:
        parts = []
        if len(rows) and len(state):
            block = rows[col][0].as_py()
            x, y, h = _codes(rows, d), rows["y"].to_numpy(), rows["row"].to_numpy().view(np.uint64)
            nodes, level = _nodes(state, "cutbin"), state["level"].to_numpy()
            for t in range(s.trees):
                if level.max() < 0:
                    node, open_ = np.ones(len(x), np.int64), np.ones(1, np.int64)
                else:
                    node, _ = _walk(nodes, x, t)
                    mine = (state["tree"].to_numpy() == t) & (level == level.max())
                    n, lo, ro = (state[c].to_numpy()[mine] for c in ("node", "lopen", "ropen"))
                    open_ = np.sort(np.concatenate([2 * n[lo.astype(bool)], 2 * n[ro.astype(bool)] + 1]))
                if len(open_):
                    at = np.minimum(np.searchsorted(open_, node), len(open_) - 1)
                    row = np.flatnonzero(open_[at] == node)
                    number, feature, b, n = _counts(x[row], y[row], _weights(s, h[row], t), at[row],
                                                    _tried(s, d, block, t, open_), s.max_bins, n_classes)
                    parts.append((np.full(len(number), t), open_[number], feature, b, n))
        if parts:
            tree, node, feature, b, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        else:
            block, tree, node, feature, b, n = 0, *([np.zeros(0, np.int64)] * 4), np.zeros((0, n_classes))
        return pa.table({col: pa.array(np.full(len(tree), block), pa.int32()), "tree": pa.array(tree, pa.int32()),
                         "node": pa.array(node, pa.int64()), "feature": pa.array(feature, pa.int32()),
                         "bin": pa.array(b, pa.int32()), **{f"c{k}": n[:, k] for k in range(n_classes)}})

    fields = "".join(f", c{k} double" for k in range(n_classes))
    return count, f"{col} int, tree int, node long, feature int, bin int{fields}"


def _cuts(number: np.ndarray, feature: np.ndarray, b: np.ndarray, n: np.ndarray, min_rows: int):
    """The rule of ``_best`` on the sorted counts of whole nodes: per node number
    (number, class counts, feature or -1, bin, counts left, counts right)."""
    first = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (feature[1:] != feature[:-1])))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(number))))
    upto = np.cumsum(n, axis=0)
    left = upto - (upto[first] - n[first])[group]
    total = np.add.reduceat(n, first, axis=0)[group]
    right = total - left
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    fits = (nl > 0) & (nr > 0) & (nl >= min_rows) & (nr >= min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(axis=1) / nl + (right * right).sum(axis=1) / nr
        fits &= score - (total * total).sum(axis=1) / (nl + nr) > (nl + nr) * 1e-12
    score = np.where(fits, score, -np.inf)
    start = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    top = np.maximum.reduceat(score, start)
    is_top = np.flatnonzero(score == np.repeat(top, np.diff(np.append(start, len(number)))))
    best = is_top[np.searchsorted(is_top, start)]          # the first: ties go to the lowest feature and bin
    return number[start], total[start], np.where(fits[best], feature[best], -1), b[best], left[best], right[best]


def _grower(s: TreeSettings, d: int, n_classes: int, col: str):
    """The step function of a block that is one chunk: its trees, all levels."""

    def grow(rows: pa.Table, state: pa.Table) -> pa.Table:
        parts = []
        if len(rows) and len(state):
            block = rows[col][0].as_py()
            x, y, h = _codes(rows, d), rows["y"].to_numpy(), rows["row"].to_numpy().view(np.uint64)
            for t in range(s.trees):
                w = _weights(s, h, t)
                row, node, open_ = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(1, np.int64)
                for level in range(s.max_depth):
                    at = np.searchsorted(open_, node)
                    found = _counts(x[row], y[row], w[row], at, _tried(s, d, block, t, open_), s.max_bins, n_classes)
                    if not len(found[0]):
                        break
                    number, total, feature, cut, left, right = _cuts(*found, s.min_rows)
                    cutting = feature >= 0
                    may = cutting & (level + 1 < s.max_depth)
                    opens = [may & (side.max(axis=1) < side.sum(axis=1)) for side in (left, right)]
                    out = np.flatnonzero(cutting | (level == 0))
                    parts.append([np.full(len(out), t), open_[number[out]], np.full(len(out), level), total[out].argmax(axis=1), feature[out], cut[out],
                                  np.where(cutting, left.argmax(axis=1), 0)[out], np.where(cutting, right.argmax(axis=1), 0)[out]])
                    # rows of the open children go on
                    by = np.full(len(open_), -1)
                    by[number] = np.arange(len(number))
                    mine = by[at]
                    row, mine = row[mine >= 0], mine[mine >= 0]
                    right_side = x[row, np.maximum(feature[mine], 0)] > cut[mine]
                    on = np.where(right_side, opens[1][mine], opens[0][mine])
                    node = (2 * open_[number[mine]] + right_side)[on]
                    row = row[on]
                    open_ = np.unique(node)
                    if not len(row):
                        break
        names = ("tree", "node", "level", "pred", "feature", "cutbin", "lpred", "rpred")
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
        kinds = [pa.int64() if c == "node" else pa.int32() for c in names]
        out = {c: pa.array(v, k, mask=v < 0) for c, v, k in zip(names, cols, kinds, strict=True)}
        closed = pa.array(np.zeros(len(cols[0]), bool))
        return pa.table({col: pa.array(np.full(len(cols[0]), block if parts else 0), pa.int32()), **out, "lopen": closed, "ropen": closed})

    return grow, NODES.format(col=col)


def _best(counts: DataFrame, s: TreeSettings, n_classes: int, level: int, col: str) -> DataFrame:
    """The best cut of every open node, and what its children hold."""
    ks = range(n_classes)
    keys = f"{col}, tree, node"

    def each(form: str, sep: str = ", ") -> str:
        return sep.join(form.format(k=k) for k in ks)

    def top(side: str) -> str:
        return f"cast(array_position({side}, array_max({side})) - 1 as int)"

    may_open = "true" if level + 1 < s.max_depth else "false"
    # the chunks have summed their rows; one partitioning serves the sums and the windows
    return counts.sparkSession.sql(f"""
WITH h AS (SELECT {keys}, feature, bin, {each('sum(c{k}) AS c{k}')} FROM {{counts}} GROUP BY {keys}, feature, bin),
upto AS (SELECT {keys}, feature, bin, {each('sum(c{k}) OVER upto AS l{k}')}, {each('sum(c{k}) OVER whole AS t{k}')} FROM h
    WINDOW upto AS (PARTITION BY {keys}, feature ORDER BY bin), whole AS (PARTITION BY {keys}, feature)),
sides AS (SELECT *, {each('l{k}', ' + ')} AS nl, {each('t{k}', ' + ')} - ({each('l{k}', ' + ')}) AS nr FROM upto),
scored AS (SELECT *, try_divide({each('l{k} * l{k}', ' + ')}, nl) + try_divide({each('(t{k} - l{k}) * (t{k} - l{k})', ' + ')}, nr) AS score,
    ({each('t{k} * t{k}', ' + ')}) / (nl + nr) AS before FROM sides),
best AS (SELECT {keys}, first(array({each('t{k}')})) AS t,
    max_by(struct(feature, bin, array({each('l{k}')}) AS l, array({each('t{k} - l{k}')}) AS r), struct(score, -feature AS f, -bin AS b))
        FILTER (WHERE nl > 0 AND nr > 0 AND nl >= {s.min_rows} AND nr >= {s.min_rows} AND score - before > (nl + nr) * 1e-12) AS x
    FROM scored GROUP BY {keys})
SELECT {keys}, {level} AS level, {top('t')} AS pred, x.feature AS feature, x.bin AS cutbin,
    coalesce({top('x.l')}, 0) AS lpred, coalesce({top('x.r')}, 0) AS rpred,
    coalesce({may_open} AND array_max(x.l) < aggregate(x.l, 0D, (a, v) -> a + v), false) AS lopen,
    coalesce({may_open} AND array_max(x.r) < aggregate(x.r, 0D, (a, v) -> a + v), false) AS ropen
FROM best""", counts=counts.repartition(col, "tree", "node", "feature"))


@dataclass
class Forests:
    """The forests of all blocks: ``nodes`` (block, tree, node, level, pred,
    feature, cut, lpred, rpred), one row an inner node or root."""

    nodes: DataFrame
    accuracy: DataFrame | None        # model_id, n_validate, accuracy
    settings: TreeSettings
    n_classes: int
    col: str = BLOCK

    #: bytes of a node in a task
    row_bytes = 48

    def table(self) -> DataFrame:
        return self.nodes.withColumnRenamed(self.col, "model_id")

    def keep(self, kept: DataFrame) -> Forests:
        """The models of a table ``model_id``."""
        return replace(self, nodes=self.nodes.join(kept.select(F.col("model_id").alias(self.col)), self.col, "left_semi"))

    def summary(self) -> DataFrame:
        """``model_id, depth, num_nodes`` (inner nodes and leaves of all its trees)."""
        inner = F.count("feature")
        trees = F.count_if(F.col("node") == 1)
        return (self.table().groupBy("model_id")
                .agg(F.coalesce(F.max(F.when(F.col("feature").isNotNull(), F.col("level") + 1)), F.lit(0)).alias("depth"),
                     (2 * inner + trees).alias("num_nodes")))

    def scorer(self, table: pa.Table):
        """x -> (rows, models) class numbers, for the models of a collected part."""
        ids = table["model_id"].to_numpy()
        parts = [_nodes(table.filter(pa.array(ids == i)), "cut") for i in np.unique(ids)]
        trees, k = self.settings.trees, self.n_classes
        return lambda x: np.stack([_forest(p, x, trees, k) for p in parts], axis=1)


def _grown(train: Dealt, blocks: DataFrame, s: TreeSettings, n_features: int, n_classes: int) -> DataFrame:
    """The nodes of blocks of many chunks, a job a level."""
    col = train.col
    count, schema = _counter(s, n_features, n_classes, col)
    nodes, started = blocks.selectExpr(
        col, "-1 AS tree", "0L AS node", "-1 AS level", "0 AS pred", "cast(null AS int) AS feature", "cast(null AS int) AS cutbin",
        "0 AS lpred", "0 AS rpred", "false AS lopen", "false AS ropen"), False
    for level in range(s.max_depth):
        new = _best(train.step(nodes, count, schema), s, n_classes, level, col)
        # one table again, so that the plan of a step is the same at every level
        nodes = checkpointed(nodes.unionByName(new.filter("feature is not null")) if started else new)
        started = True
        if not nodes.filter((F.col("level") == level) & (F.col("lopen") | F.col("ropen"))).limit(1).count():
            break
    return nodes


def fit_forests(rows: DataFrame, s: TreeSettings, n_features: int, n_classes: int, order: str = "row_id",
                col: str = BLOCK, chunk_rows: int = CHUNK_ROWS) -> Forests:
    """Trees of all blocks from rows (block, row id, y 0..n_classes-1, role,
    features); rows of role ``validate`` only measure the accuracy of their own
    block's model."""
    cuts = checkpointed(cuts_by_block(rows.filter("role = 'train'"), n_features, s.max_bins, col))
    dealt = deal(rows.select(col, F.xxhash64(order).alias("row"), "y", "role", "features"), "row", col, chunk_rows)
    binned = dealt.mapped(cuts, lambda r, st: _bin(r, st, col), f"row long, y int, role string, {col} int, bins binary")
    train = binned.only("train")
    whole, large = train.split()
    grow, kind = _grower(s, n_features, n_classes, col)
    nodes = checkpointed(whole.step(cuts.select(col), grow, kind))
    if large.any():
        nodes = checkpointed(nodes.unionByName(_grown(large, cuts, s, n_features, n_classes)))
    accuracy = _own_accuracy(binned.only("validate"), nodes, n_features, s, n_classes)
    dealt.release()
    binned.release()
    value = F.when(F.col("feature").isNotNull(), F.col("cuts")[F.col("feature")][F.col("cutbin")])
    out = nodes.join(cuts, col).select(col, "tree", "node", "level", "pred", "feature", value.alias("cut"), "lpred", "rpred")
    return Forests(checkpointed(out), accuracy, s, n_classes, col)


def _own_accuracy(validate: Dealt, nodes: DataFrame, d: int, s: TreeSettings, n_classes: int) -> DataFrame:
    """C2 for all blocks in one job: ``model_id, n_validate, accuracy``."""
    col = validate.col

    def judge(rows: pa.Table, state: pa.Table) -> pa.Table:
        hit = 0
        if len(rows) and len(state):
            hit = int((_forest(_nodes(state, "cutbin"), _codes(rows, d), s.trees, n_classes) == rows["y"].to_numpy()).sum())
        some = rows if len(rows) else state
        return pa.table({col: pa.array([some[col][0].as_py()], pa.int32()), "n": [len(rows)], "hit": [hit]})

    got = validate.step(nodes, judge, f"{col} int, n long, hit long").groupBy(col).agg(F.sum("n").alias("n_validate"), F.sum("hit").alias("_h"))
    return checkpointed(got.select(F.col(col).alias("model_id"), "n_validate", F.try_divide(F.col("_h"), F.col("n_validate")).alias("accuracy")))
