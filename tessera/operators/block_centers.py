"""K5: k-means and bisecting k-means of all blocks, a step of all blocks a job.

Distances come from matrix products over the rows of a chunk; where two centers
are equally near up to rounding, the row's distances are taken again term by term, so
ties go to the lowest center.  A chunk returns counts and sums of its rows by
center, Spark adds them.  A block that fits one chunk takes all its steps in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lockstep import Dealt, checkpointed, matrix, mixed

#: bytes of distances held at once
AT_ONCE = 8 << 20


def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distance of every row to one center (or to a center a row)."""
    return ((x - center) ** 2).sum(axis=1)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center of every row (ties: the lowest)."""
    out = np.empty(len(x), np.int64)
    cc = (centers * centers).sum(axis=1)
    step = max(1, AT_ONCE // (8 * len(centers)))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        xx = np.einsum("ij,ij->i", part, part)
        d = centers @ part.T                      # a row a center: the steps below run along the rows
        d *= -2
        d += cc[:, None]
        d += xx
        low = d.min(axis=0)
        near = d <= low + 1e-9 * (xx + cc.max())
        best = near.argmax(axis=0) if len(centers) > 64 else np.zeros(len(part), np.int64)
        for c in range(1, len(centers) if len(centers) <= 64 else 0):
            best[d[c] == low] = c
        tied = np.flatnonzero(near.sum(axis=0) > 1)
        few = max(1, AT_ONCE // (8 * centers.size))
        for at in (tied[i:i + few] for i in range(0, len(tied), few)):
            exact = ((part[at, None] - centers) ** 2).sum(axis=2)
            best[at] = np.where(near[:, at].T, exact, np.inf).argmin(axis=1)
        out[lo:lo + step] = best
    return out


def _means(x: np.ndarray, at: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Means of the rows of each center; a center without rows stays."""
    hot = at == np.arange(len(centers))[:, None]
    n = hot.sum(axis=1)
    return np.where(n[:, None] > 0, (hot.astype(float) @ x) / np.maximum(n, 1)[:, None], centers)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """The first row, then k - 1 times the row farthest from the ones so far."""
    picked, d = [0], np.full(len(x), np.inf)
    while len(picked) < k:
        d = np.minimum(d, distances(x, x[picked[-1]]))
        picked.append(int(d.argmax()))
    return x[picked]


def _lloyd(x: np.ndarray, centers: np.ndarray, steps: int, tol: float) -> np.ndarray:
    for _ in range(steps):
        new = _means(x, nearest(x, centers), centers)
        moved = ((new - centers) ** 2).sum(axis=1).max()
        centers = new
        if moved <= tol * tol:
            break
    return centers


# ------------------------------------------------------------------- k-means
def kmeans_whole(dealt: Dealt, start: DataFrame | None, k: int, steps: int, order: str, farthest: bool, tol: float) -> DataFrame:
    """``block, cluster, center`` of blocks of one chunk; ``start`` is a center
    table or None (the ``k`` lowest or farthest-first rows)."""
    col, given = dealt.col, start is not None

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        if not len(rows) or not len(state):
            ids, centers, block = np.zeros(0, int), np.zeros((0, 0)), 0
        else:
            x, block = matrix(rows["features"]), rows[col][0].as_py()
            if given:
                state = state.sort_by("cluster")
                ids, centers = state["cluster"].to_numpy(), matrix(state["center"])
            else:
                centers = farthest_first(x, k) if farthest else x[:k]
                ids = np.arange(len(centers))
            centers = _lloyd(x, centers, steps, tol)
        return pa.table({col: pa.array(np.full(len(ids), block), pa.int32()), "cluster": pa.array(ids, pa.int32()),
                         "center": pa.array(centers.tolist(), pa.list_(pa.float64()))})

    state = start if start is not None else dealt.sizes.select(col)
    return dealt.step(state, run, f"{col} int, cluster int, center array<double>")


def lowest_step(dealt: Dealt, k: int, order: str) -> DataFrame:
    """``block, order, features``: rows that hold each block's ``k`` lowest, nulls first."""
    col = dealt.col

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids = len(rows) - rows[order].null_count           # a chunk holds its null ids last
        found = pa.concat_tables([rows.slice(ids, k), rows.slice(0, min(k, ids))])
        return found.select([col, order, "features"])

    kind = dealt.schema[order].dataType.simpleString()
    return dealt.step(dealt.sizes.select(col), run, f"{col} int, `{order}` {kind}, features array<double>")


def farthest_step(dealt: Dealt, centers: DataFrame, order: str) -> DataFrame:
    """``block, center``: each block's row farthest from its centers so far (ties:
    the lowest ``order``)."""
    col = dealt.col

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        rows = rows.slice(0, len(rows) if len(state) else 0)
        if len(rows):
            x, c = matrix(rows["features"]), matrix(state["center"])
            d = np.min([distances(x, one) for one in c], axis=0)
            rows = rows.slice(int(d.argmax()), 1).append_column("d", pa.array([float(d.max())]))
        else:
            rows = rows.append_column("d", pa.array([], pa.float64()))
        return rows.select([col, order, "features", "d"])

    kind = dealt.schema[order].dataType.simpleString()
    found = dealt.step(centers, run, f"{col} int, `{order}` {kind}, features array<double>, d double")
    return found.groupBy(col).agg(F.max_by("features", F.struct("d", (-F.col(order)).alias("o"))).alias("center"))


def draw_far(dealt: Dealt, centers: DataFrame, order: str, size: int, *salts: int) -> DataFrame:
    """``block, cluster, center``: ``size`` rows of each block, drawn without replacement with
    chances in proportion to their squared distance from the block's centers; rows
    on a center are never drawn.  ``cluster`` numbers them from 0.

    A row's key is an exponential of rate d**2 made from its id, and the smallest
    keys win (Efraimidis and Spirakis 2006): no total is needed first, and a chunk
    sends its own ``size`` smallest only.  The same rows win however they are dealt.
    """
    col = dealt.col

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        keys = np.zeros(0)
        if len(rows) and len(state):
            state = state.sort_by("cluster")
            x, c = matrix(rows["features"]), matrix(state["center"])
            d = distances(x, c[nearest(x, c)])
            h = mixed(rows[order].to_numpy().astype(float).view(np.uint64), *salts)
            u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
            with np.errstate(divide="ignore"):
                keys = np.where(d > 0, -np.log(u) / d, np.inf)
            some = np.argsort(keys, kind="stable")[:size]
            some = some[np.isfinite(keys[some])]
            rows, keys = rows.take(pa.array(some)), keys[some]
        else:
            rows = rows.slice(0, 0)
        return rows.select([col, order, "features"]).append_column("key", pa.array(keys, pa.float64()))

    kind = dealt.schema[order].dataType.simpleString()
    found = dealt.step(centers, run, f"{col} int, `{order}` {kind}, features array<double>, key double")
    place = F.row_number().over(Window.partitionBy(col).orderBy("key", order))
    return (found.withColumn("_r", place).filter(F.col("_r") <= size)
            .select(col, (F.col("_r") - 1).cast("int").alias("cluster"), F.col("features").alias("center")))


def weights(dealt: Dealt, centers: DataFrame) -> DataFrame:
    """``block, cluster, n``: rows nearest to each center that has any."""
    col = dealt.col

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids, n, block = np.zeros(0, int), np.zeros(0, int), 0
        if len(rows) and len(state):
            state = state.sort_by("cluster")
            at = nearest(matrix(rows["features"]), matrix(state["center"]))
            some, n = np.unique(at, return_counts=True)
            ids, block = state["cluster"].to_numpy()[some], rows[col][0].as_py()
        return pa.table({col: pa.array(np.full(len(ids), block), pa.int32()), "cluster": pa.array(ids, pa.int32()),
                         "n": pa.array(n, pa.int64())})

    return dealt.step(centers, run, f"{col} int, cluster int, n long").groupBy(col, "cluster").agg(F.sum("n").alias("n"))


def spread_out(x: np.ndarray, w: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """``k`` centers of weighted points: the heaviest, then k - 1 times the one of the
    largest weight times squared distance from those so far, then weighted Lloyd
    steps.  With fewer distinct points the picked ones are repeated."""
    picked, d = [int(w.argmax())], np.full(len(x), np.inf)
    while len(picked) < k:
        d = np.minimum(d, distances(x, x[picked[-1]]))
        if not (w * d).any():
            break
        picked.append(int((w * d).argmax()))
    centers = x[picked]
    for _ in range(steps):
        share = (nearest(x, centers) == np.arange(len(centers))[:, None]) * w
        n = share.sum(axis=1)
        new = np.where(n[:, None] > 0, share @ x / np.maximum(n, 1)[:, None], centers)
        if (new == centers).all():
            break
        centers = new
    return centers[np.arange(k) % len(centers)]


def pick_of(candidates: DataFrame, k: int, col: str) -> DataFrame:
    """``block, cluster, center``: ``k`` centers from each block's weighted candidates
    (``cluster, center, n``), whose number parameters bound."""
    def run(rows: pa.Table) -> pa.Table:
        block, rows = rows[col][0].as_py(), rows.sort_by("cluster")
        centers = spread_out(matrix(rows["center"]), rows["n"].to_numpy().astype(float), k)
        return pa.table({col: pa.array([block] * k, pa.int32()), "cluster": pa.array(range(k), pa.int32()),
                         "center": pa.array(centers.tolist(), pa.list_(pa.float64()))})

    return candidates.groupBy(col).applyInArrow(run, f"{col} int, cluster int, center array<double>")


def lloyd_sums(dealt: Dealt, centers: DataFrame) -> DataFrame:
    """``block, cluster, _new``: the mean of the rows nearest to each center."""
    col = dealt.col

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids, n, sums, block = np.zeros(0, int), np.zeros(0), [], 0
        if len(rows) and len(state):
            state = state.sort_by("cluster")
            x, block = matrix(rows["features"]), rows[col][0].as_py()
            hot = nearest(x, matrix(state["center"])) == np.arange(len(state))[:, None]
            some = np.flatnonzero(hot.any(axis=1))
            ids, n, sums = state["cluster"].to_numpy()[some], hot[some].sum(axis=1).astype(float), (hot[some].astype(float) @ x).tolist()
        return pa.table({col: pa.array(np.full(len(ids), block), pa.int32()), "cluster": pa.array(ids, pa.int32()),
                         "n": n, "s": pa.array(sums, pa.list_(pa.float64()))})

    parts = dealt.step(centers, run, f"{col} int, cluster int, n double, s array<double>")
    total = parts.groupBy(col, "cluster").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return total.select(col, "cluster", F.transform("s", lambda v: v / F.col("n")).alias("_new"))


# ------------------------------------------------------------------- bisecting
def _halves(x: np.ndarray, center: np.ndarray, max_iter: int):
    """(left center, right center, right?) of the rows of a node; None if they are all equal."""
    a = x[int(distances(x, center).argmax())]
    d = distances(x, a)
    if d.max() == 0:
        return None
    pair = _lloyd(x, np.stack([a, x[int(d.argmax())]]), max_iter, 0.0)
    return pair[0], pair[1], nearest(x, pair) == 1


def _pick(sizes: dict[int, int], leaves: int, k: int) -> list[int]:
    """The largest nodes (ties: the lowest) that bring the leaves to k at most."""
    return sorted(sizes, key=lambda node: (-sizes[node], node))[:max(0, k - leaves)]


def _bisect(x: np.ndarray, k: int, max_iter: int) -> list[tuple[int, np.ndarray]]:
    """(node, center) of the leaves."""
    rows = {1: np.arange(len(x))}
    centers, single = {1: x.mean(axis=0)}, set()
    while True:
        picked = _pick({n: len(r) for n, r in rows.items() if len(r) > 1 and n not in single}, len(rows), k)
        if not picked:
            return sorted(centers.items())
        for node in picked:
            got = _halves(x[rows[node]], centers[node], max_iter)
            if got is None or got[2].all() or not got[2].any():
                single.add(node)
                continue
            mine = rows.pop(node)
            centers.pop(node)
            rows[2 * node], rows[2 * node + 1] = mine[~got[2]], mine[got[2]]
            centers[2 * node], centers[2 * node + 1] = got[0], got[1]


def bisect_whole(dealt: Dealt, k: int, order: str, max_iter: int) -> DataFrame:
    """``block, node, center`` of blocks of one chunk."""
    col = dealt.col

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        got = _bisect(matrix(rows["features"]), k, max_iter) if len(rows) and len(state) else []
        block = state[col][0].as_py() if len(state) else 0
        return pa.table({col: pa.array([block] * len(got), pa.int32()), "node": pa.array([n for n, _ in got], pa.int64()),
                         "center": pa.array([c.tolist() for _, c in got], pa.list_(pa.float64()))})

    return dealt.step(dealt.sizes.select(dealt.col), run, f"{col} int, node long, center array<double>")


#: what a node of the tree is: a leaf, cut in two (``a``, ``b``), being cut, or of equal rows
LEAF, INNER, CUTTING, SINGLE = range(4)


def _routed(rows: pa.Table, state: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(features, node) of the rows, led down the inner nodes."""
    x = matrix(rows["features"])
    node = np.ones(len(x), np.int64)
    inner = {n: np.array([a, b]) for n, kind, a, b in zip(*(state[c].to_pylist() for c in ("node", "kind", "a", "b")), strict=True) if kind == INNER}
    for n in sorted(inner):                       # a parent comes before its children
        mine = np.flatnonzero(node == n)
        node[mine] = 2 * n + nearest(x[mine], inner[n])
    return x, node


def bisect_large(dealt: Dealt, k: int, order: str, max_iter: int) -> DataFrame:
    """``block, node, center`` of blocks of many chunks: about log2(k) rounds of at
    most ``max_iter`` + 2 jobs for all blocks."""
    col = dealt.col
    vec = "array<double>"

    def farthest(rows: pa.Table, state: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(state):
            x, node = _routed(rows, state)
            for n, kind, at in zip(*(state[c].to_pylist() for c in ("node", "kind", "at")), strict=True):
                mine = np.flatnonzero(node == n)
                if kind == CUTTING and len(mine):
                    d = distances(x[mine], np.array(at))
                    top = mine[int(d.argmax())]
                    out.append((rows[col][0].as_py(), n, float(d.max()), rows[order][int(top)].as_py(), x[top].tolist()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5,
                                                        (pa.int32(), pa.int64(), pa.float64(), rows.schema.field(order).type, pa.list_(pa.float64())), strict=True)],
                        names=[col, "node", "d", "o", "x"])

    def sums(rows: pa.Table, state: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(state):
            x, node = _routed(rows, state)
            for n, kind, a, b in zip(*(state[c].to_pylist() for c in ("node", "kind", "a", "b")), strict=True):
                mine = x[node == n]
                if kind == CUTTING and len(mine):
                    side = nearest(mine, np.array([a, b])) == 1
                    out += [(rows[col][0].as_py(), n, r, float((side == r).sum()), mine[side == r].sum(axis=0).tolist())
                            for r in (False, True) if (side == r).any()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5,
                                                        (pa.int32(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64())), strict=True)],
                        names=[col, "node", "r", "n", "s"])

    def whole(rows: pa.Table, state: pa.Table) -> pa.Table:
        some = rows.slice(0, 1)
        s = [matrix(rows["features"]).sum(axis=0).tolist()] * len(some)
        return pa.table({col: some[col], "n": pa.array([float(len(rows))] * len(some)), "s": pa.array(s, pa.list_(pa.float64()))})

    def total(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))

    mean = F.transform("s", lambda v: v / F.col("n"))

    def added(state: DataFrame) -> DataFrame:
        parts = dealt.step(state, sums, f"{col} int, node long, r boolean, n double, s {vec}")
        side = [F.max(F.when(F.col("r") == r, F.struct(mean.alias("c"), "n"))).alias(c) for r, c in ((False, "_l"), (True, "_r"))]
        return total(parts, col, "node", "r").groupBy(col, "node").agg(*side)

    def far(state: DataFrame) -> DataFrame:
        kind = dealt.schema[order].dataType.simpleString()
        found = dealt.step(state, farthest, f"{col} int, node long, d double, o {kind}, x {vec}")
        return found.groupBy(col, "node").agg(F.max_by(F.struct("d", "x"), F.struct("d", (-F.col("o")).alias("o"))).alias("_f"))

    # the root: its mean is both sides' at equal centers
    none = F.lit(None).cast(vec)
    origin = total(dealt.step(dealt.sizes.select(col), whole, f"{col} int, n double, s {vec}"), col).select(
        col, "n", mean.alias("center"))
    tree = checkpointed(origin.join(F.broadcast(dealt.sizes.select(col)), col, "left_semi").select(
        col, F.lit(1).cast("long").alias("node"), F.lit(LEAF).alias("kind"), "n", "center", none.alias("a"), none.alias("b"), none.alias("at")))
    while True:
        leaf = F.col("kind").isin(LEAF, SINGLE)
        able = (F.col("kind") == LEAF) & (F.col("n") > 1)
        rank = F.row_number().over(Window.partitionBy(col).orderBy(F.desc(able), F.desc("n"), "node"))      # a row a node
        need = k - F.sum(leaf.cast("int")).over(Window.partitionBy(col))
        cut = tree.withColumn("_cut", able & (rank <= need))
        state = checkpointed(cut.withColumn("kind", F.when(F.col("_cut"), F.lit(CUTTING)).otherwise(F.col("kind")))
                             .withColumn("at", F.col("center")).drop("_cut"))
        if not state.filter(F.col("kind") == CUTTING).limit(1).count():
            return tree.filter(leaf).select(col, "node", "center")
        state = checkpointed(state.join(far(state), [col, "node"], "left").withColumn("a", F.coalesce("_f.x", "a")).withColumn("at", F.col("a")).drop("_f"))
        state = state.join(far(state), [col, "node"], "left")
        state = state.withColumn("kind", F.when((F.col("kind") == CUTTING) & (F.col("_f.d") == 0), F.lit(SINGLE)).otherwise(F.col("kind")))
        state = checkpointed(state.withColumn("b", F.when(F.col("kind") == CUTTING, F.col("_f.x")).otherwise(F.col("b"))).drop("_f"))
        for _ in range(max_iter):
            got = added(state)
            new = checkpointed(state.join(got, [col, "node"], "left"))
            moved = new.filter((F.col("kind") == CUTTING) & ((F.col("_l.c") != F.col("a")) | (F.col("_r.c") != F.col("b")))).limit(1).count()
            if not moved:              # these are the sums at the centers
                full = new
                break
            state = (new.withColumn("a", F.coalesce("_l.c", "a")).withColumn("b", F.coalesce("_r.c", "b")).drop("_l", "_r"))
        else:
            state = checkpointed(state)
            full = state.join(added(state), [col, "node"], "left")
        both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
        kind = F.when(F.col("kind") != CUTTING, F.col("kind")).when(both, F.lit(INNER)).otherwise(F.lit(SINGLE))
        full = checkpointed(full.withColumn("_was", F.col("kind")).withColumn("kind", kind))
        children = full.filter((F.col("_was") == CUTTING) & (F.col("kind") == INNER)).select(col, "node", F.explode(F.array(
            F.struct((2 * F.col("node")).alias("to"), F.col("_l.n").alias("n"), F.col("a").alias("center")),
            F.struct((2 * F.col("node") + 1).alias("to"), F.col("_r.n").alias("n"), F.col("b").alias("center")))).alias("x"))
        tree = checkpointed(full.select(*tree.columns).unionByName(children.select(
            col, F.col("x.to").alias("node"), F.lit(LEAF).alias("kind"), "x.n", "x.center", none.alias("a"), none.alias("b"), none.alias("at"))))
