"""K2, K7: bisecting k-means of all rows, the clusters of a level cut together.

The rules are those of MLlib's BisectingKMeans (Steinbach et al. 2000): every
cluster of the level is cut from two starts beside its mean, drawn from the seed in MLlib's
order of clusters; if that were too many leaves, the largest are cut.  What differs is the way: rows are packed
where they lie, many to an Arrow buffer, so a pass is matrix products and sends sums
only; a level ends as soon as no center moves (all further passes would repeat
the last); and a level reads the rows of the clusters that it cuts, not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.block_centers import distances, nearest
from tessera.operators.blocks import materialise

#: rows packed into one buffer
PACK_ROWS = 10_000
EPSILON = float(np.finfo(float).eps)
LEVELS = 63                                   # nodes are numbered 1, 2n, 2n + 1 in a long
PACKED = "node long, x binary"


class Draws:
    """``java.util.Random``, from which MLlib draws its starts."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - bits)

    def doubles(self, n: int) -> np.ndarray:
        return np.array([((self._next(26) << 27) + self._next(27)) * 2.0**-53 for _ in range(n)])


def _spread(n: int) -> int:
    """Murmur3 of a 32-bit number, by which Spark's tables of a task place their keys."""
    def turned(v: int, by: int) -> int:
        return (v << by | v >> (32 - by)) & 0xFFFFFFFF

    h = turned(turned(n * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _mixed(n: int) -> int:
    """The hash by which Scala's maps place a number."""
    n &= 0xFFFFFFFF
    h = n + (~(n << 9) & 0xFFFFFFFF) & 0xFFFFFFFF
    h ^= h >> 14
    h = h + (h << 4) & 0xFFFFFFFF
    return h ^ h >> 10


def _listed(nodes: list[int], shift: int = 0) -> list[int]:
    """The order of Scala's maps: up to four keys as they came, more by five bits at a time."""
    if len(nodes) <= 4 and not shift:
        return nodes
    slots = {}
    for n in nodes:
        slots.setdefault(_mixed(n) >> shift & 31, []).append(n)
    order = [slots[i] for i in sorted(slots)]
    return [g[0] for g in order if len(g) == 1] + [n for g in order if len(g) > 1 for n in _listed(g, shift + 5)]


def _in_turn(nodes, parts: int) -> list[int]:
    """The order in which MLlib draws starts for clusters: that of a map of the sums that ``parts``
    partitions return."""
    size = 64
    while len(nodes) > 0.7 * size:
        size *= 2
    return _listed(sorted(nodes, key=lambda n: (n % parts, _spread(n & 0xFFFFFFFF) & (size - 1), n)))


def _checked(column: pa.Array) -> np.ndarray:
    """(n, d) doubles; null, not finite or unequally long vectors are errors."""
    if column.null_count:
        raise ValueError("features must not be null")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("features must be of one length")
    if not np.isfinite(values).all():
        raise ValueError("features must not hold null, NaN or infinity")
    return values.reshape(len(size), -1)


def _sent(node: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["node", "x"])


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for i in range(len(b)):
            yield b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_buffer(), float).reshape(-1, d)


def _side(x: np.ndarray, near: tuple[list[int], np.ndarray]) -> np.ndarray:
    return nearest(x, near[1]) if len(near[0]) > 1 else np.zeros(len(x), np.int64)


def _pack(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _checked(b.column(0))
            for lo in range(0, len(x), PACK_ROWS):
                yield _sent(1, x[lo:lo + PACK_ROWS])

    return materialise(points.select("features").mapInArrow(run, PACKED))


def _routed(packed: DataFrame, near: dict, cut: set[int], d: int) -> DataFrame:
    """The rows of the nodes in ``cut``, from those of their parents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: [] for n in cut}
        for node, x in _chunks(batches, d):
            side = _side(x, near[node]) if node in near else np.zeros(0, np.int64)
            for i, child in enumerate(near[node][0] if node in near else []):
                if child in cut and (side == i).any():
                    held[child].append(x[side == i])
                    if sum(map(len, held[child])) >= PACK_ROWS:
                        yield _sent(child, np.concatenate(held[child]))
                        held[child] = []
        for child, parts in held.items():
            if parts:
                yield _sent(child, np.concatenate(parts))

    return materialise(packed.mapInArrow(run, PACKED))


def _sums(packed: DataFrame, near: dict, d: int) -> dict[int, tuple[int, np.ndarray, float]]:
    """One pass: {child: (rows, mean, cost)} of the children of each node whose centers
    ``near`` holds; children without rows are left out.  A task sends one row a child; the
    sums of the tasks are added in their order, so that equal rows give equal means."""
    kind = "node long, part int, n long, s array<double>, q double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for node, x in _chunks(batches, d):
            if node not in near:
                continue
            ids, centers = near[node]
            side = _side(x, near[node])
            hot = side == np.arange(len(ids))[:, None]
            far, sums = distances(x, centers[side]), hot.astype(float) @ x
            for i, child in enumerate(ids):
                n, s, q = total.get(child, (0, 0.0, 0.0))
                total[child] = n + int(hot[i].sum()), s + sums[i], q + float(far[hot[i]].sum())
        part = TaskContext.get().partitionId()
        some = [(c, n, s.tolist(), q) for c, (n, s, q) in total.items() if n]
        columns = [[r[0] for r in some], [part] * len(some), *([r[i] for r in some] for i in (1, 2, 3))]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                         names=["node", "part", "n", "s", "q"])

    def added(name: str):
        return F.aggregate("parts", F.lit(0.0), lambda a, r: a + r[name])

    parts = packed.mapInArrow(run, kind).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("part", "n", "s", "q"))).alias("parts"))
    sums = F.aggregate("parts", F.array_repeat(F.lit(0.0), d), lambda a, r: F.zip_with(a, r["s"], lambda u, v: u + v))
    got = parts.select("node", added("n").cast("long").alias("n"), sums.alias("s"), added("q").alias("q")).collect()    # a row a child
    at = {child: c for ids, centers in near.values() for child, c in zip(ids, centers, strict=True)}
    out = {}
    for r in sorted(got, key=lambda r: r["node"]):
        mean = np.array(r["s"]) / r["n"]
        moved = float(((mean - at[r["node"]]) ** 2).sum())      # the distances were those to the old center
        out[r["node"]] = r["n"], mean, max(r["q"] - r["n"] * moved, 0.0)
    return out


def _by_parent(centers: dict[int, np.ndarray]) -> dict:
    """{node: (children, their centers)}."""
    out = {}
    for child in sorted(centers):
        out.setdefault(child // 2, []).append(child)
    return {n: (ids, np.array([centers[c] for c in ids])) for n, ids in out.items()}


def _settled(packed: DataFrame, centers: dict[int, np.ndarray], max_iter: int, d: int):
    """Passes until no center moves, ``max_iter`` at most: the children of the last pass."""
    for _ in range(max_iter):
        found = _sums(packed, _by_parent(centers), d)
        still = found.keys() == centers.keys() and all((found[c][1] == centers[c]).all() for c in found)
        centers = {c: mean for c, (_, mean, _) in found.items()}
        if still:
            break
    return found


def bisect(points: DataFrame, k: int, seed: int, max_iter: int) -> dict[int, tuple[int, np.ndarray, float]]:
    """{node: (rows, center, cost)} of the whole tree; node n has the children 2n and 2n + 1."""
    one = points.select(F.size("features").alias("d")).first()
    if one is None:
        raise ValueError("no rows to cluster")
    d, packed = one["d"], _pack(points)
    try:
        # the root is the only child of node 0; the second pass gives its cost about its mean
        root = packed.withColumn("node", F.lit(0).cast("long"))
        active = _settled(root, {1: np.zeros(d)}, 2, d)
        parts = int(points.sparkSession.conf.get("spark.default.parallelism", None) or packed.rdd.getNumPartitions())
        tree, draws, need, level = dict(active), Draws(seed), k - 1, 1
        while active and need > 0 and level < LEVELS:
            cut = [n for n in _in_turn(active, parts) if active[n][2] > EPSILON * active[n][0]]
            if len(cut) > need:
                cut = _listed(sorted(cut, key=lambda n: -active[n][0])[:need])
            if not cut:
                break
            if level > 1:
                old, packed = packed, _routed(packed, _by_parent({n: active[n][1] for n in active}), set(cut), d)
                packed.count()
                old.unpersist()
            starts = {}
            for n in cut:
                mean = active[n][1]
                step = 1e-4 * np.sqrt((mean * mean).sum()) * draws.doubles(d)
                starts[2 * n], starts[2 * n + 1] = mean - step, mean + step
            active = _settled(packed, starts, max_iter, d)
            tree |= active
            need, level = need - len(cut), level + 1
    finally:
        packed.unpersist()
    return tree


def model_of(spark: SparkSession, est: BisectingKMeans, tree: dict[int, tuple[int, np.ndarray, float]]) -> BisectingKMeansModel:
    """MLlib's model of the tree: it predicts, is saved and loaded like any other."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    linalg, mllib = jvm.org.apache.spark.mllib.linalg, jvm.org.apache.spark.mllib.clustering
    numbers = {"leaf": 0, "inner": -1}
    cost = []

    def built(n: int):
        rows, center, q = tree[n]
        values = gateway.new_array(jvm.double, len(center))
        for i, v in enumerate(center):
            values[i] = float(v)
        at = mllib.VectorWithNorm(linalg.DenseVector(values))
        below = [c for c in (2 * n, 2 * n + 1) if c in tree] if 2 * n in tree else []
        number = numbers["inner" if below else "leaf"]
        numbers["inner" if below else "leaf"] += -1 if below else 1
        if not below:
            cost.append(q)
        height = max((float(np.sqrt(((center - tree[c][1]) ** 2).sum())) for c in below), default=0.0)
        children = gateway.new_array(mllib.ClusteringTreeNode, len(below))
        for i, c in enumerate(below):
            children[i] = built(c)
        return mllib.ClusteringTreeNode(number, rows, at, q, height, children)

    root = built(1)
    java = jvm.org.apache.spark.ml.clustering.BisectingKMeansModel(
        est.uid, mllib.BisectingKMeansModel(root, "euclidean", float(sum(cost))))
    est._transfer_params_to_java()
    return est._copyValues(BisectingKMeansModel(est._java_obj.copyValues(java, jvm.org.apache.spark.ml.param.ParamMap.empty())))


def fit_bisecting(points: DataFrame, k: int, seed: int = 1, max_iter: int = 20) -> BisectingKMeansModel:
    """The fitted model of ``features``, as MLlib's BisectingKMeans gives it."""
    est = BisectingKMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="vec")
    return model_of(points.sparkSession, est, bisect(points, k, seed, max_iter))
