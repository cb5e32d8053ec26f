"""Clustering over blocks.

Points are ``row_id, block_id, label, features ARRAY<DOUBLE>``; centers are
``block_id, cluster, center ARRAY<DOUBLE>`` (local) or ``center_id, center``.

* K5 ``local_kmeans`` and ``local_bisecting`` advance **all blocks in one job
  per step** (``block_centers``): points are dealt to chunks once, a chunk meets
  its own block's centers, finds the nearest by matrix products (ties -> lowest
  id) and returns sums, which Spark adds by ``(block, cluster)``.  The tiny
  center table is checkpointed to the shared checkpoint folder after every
  step, so lineage stays short and a lost executor never replays earlier steps.
* K7 second level: MLlib KMeans / BisectingKMeans on the pooled centers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import sq_distance
from tessera.operators.bisecting import fit_bisecting
from tessera.operators.block_centers import (bisect_large, bisect_whole, distances, draw_far, farthest_step, kmeans_whole,
                                             lloyd_sums, lowest_step, nearest, pick_of, weights)
from tessera.operators.blocks import BLOCK
from tessera.operators.lockstep import CHUNK_ROWS, Dealt, checkpointed, deal, matrix

# Largest center table (bytes) shipped at once.
BROADCAST_CENTERS = 64 << 20


def center_bytes(centers: DataFrame) -> int:
    """Bytes of a center table: 8 a coordinate and a few words a row."""
    return centers.agg(F.sum(F.lit(64) + 8 * F.size("center"))).first()[0] or 0


def _bcast(df: DataFrame, n_bytes: int, limit: int = BROADCAST_CENTERS) -> DataFrame:
    """Broadcast up to ``limit`` bytes; above it a shuffle join, whose hot blocks AQE splits."""
    return F.broadcast(df) if n_bytes <= limit else df


# ---------------------------------------------------------------------- K5
def init_lowest(points: DataFrame | Dealt, k: int, order: str = "row_id", col: str = BLOCK) -> DataFrame:
    """Initial centers: the ``k`` points with the lowest ``order`` per block
    (cluster = rank - 1).  ``row_number() <= k`` lets Spark keep only k rows
    per block in every task before the shuffle (window group limit)."""
    w = Window.partitionBy(col).orderBy(order)
    if isinstance(points, Dealt):
        points = lowest_step(points, k, order)
    return (points.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .select(col, (F.col("_r") - 1).cast("int").alias("cluster"), F.col("features").alias("center")))


def init_farthest(points: DataFrame | Dealt, k: int, order: str = "row_id", col: str = BLOCK) -> DataFrame:
    """Initial centers by farthest-first traversal per block: the lowest
    ``order`` point, then k-1 times the point farthest from the centers so
    far (ties -> lowest ``order``).  One pass per center, all blocks at once;
    deterministic."""
    dealt = points if isinstance(points, Dealt) else deal(points.select(col, order, "features"), order, col)
    centers = checkpointed(init_lowest(dealt, 1, order, col))
    for c in range(1, k):
        far = farthest_step(dealt, centers, order)
        centers = checkpointed(centers.unionByName(far.select(col, F.lit(c).alias("cluster"), "center")))
    if dealt is not points:
        dealt.release()
    return centers


def init_oversampled(points: DataFrame | Dealt, k: int, order: str = "row_id", col: str = BLOCK, rounds: int = 4,
                     over: float = 2.0, seed: int = 0) -> DataFrame:
    """Initial centers by oversampling (k-means||, Bahmani et al. 2012), all blocks at once.

    From each block's lowest ``order`` row on, each of ``rounds`` passes adds
    ``over * k`` rows drawn by their squared distance from the candidates so far.
    One more pass weighs the candidates by the rows nearest to them, and ``k``
    centers are picked from these ``rounds * over * k + 1`` a block.  The passes do
    not depend on ``k`` (``init_farthest`` takes one a center).  The draws
    depend on ``seed`` and the rows' ids alone.
    """
    if rounds < 1 or over <= 0:
        raise ValueError("rounds and over must be positive")
    size = int(np.ceil(over * k))
    dealt = points if isinstance(points, Dealt) else deal(points.select(col, order, "features"), order, col)
    found = checkpointed(init_lowest(dealt, 1, order, col))
    for r in range(rounds):
        drawn = draw_far(dealt, found, order, size, seed, r)
        found = checkpointed(found.unionByName(drawn.withColumn("cluster", F.col("cluster") + (1 + r * size))))
    weighed = found.join(weights(dealt, found), [col, "cluster"], "left").fillna(0, ["n"])
    centers = checkpointed(pick_of(weighed, k, col))
    if dealt is not points:
        dealt.release()
    return centers


def _centers_by_block(centers: DataFrame, col: str) -> DataFrame:
    return centers.groupBy(col).agg(
        F.collect_list(F.struct(F.col("cluster"), F.col("center"))).alias("_cs"))


def assign_local(points: DataFrame, centers: DataFrame, n_bytes: int | None = None,
                 col: str = BLOCK, out: str = "cluster") -> DataFrame:
    """Nearest center of the point's own block (ties -> lowest cluster)."""
    cs = _centers_by_block(centers, col)
    n = n_bytes if n_bytes is not None else center_bytes(centers)
    nearest = F.array_min(F.transform(
        "_cs", lambda s: F.struct(sq_distance(F.col("features"), s["center"]).alias("d"),
                                  s["cluster"].alias("c"))))
    return (points.join(_bcast(cs, n), col)
            .withColumn(out, nearest["c"]).drop("_cs"))


def lloyd_step(points: DataFrame | Dealt, centers: DataFrame, n_bytes: int, col: str = BLOCK) -> DataFrame:
    """One Lloyd step for all blocks; empty clusters keep their center.
    ``n_bytes`` is the size of the center table (``center_bytes``)."""
    dealt = points if isinstance(points, Dealt) else deal(points.select(col, "features"), "features", col)
    means = lloyd_sums(dealt, centers)
    out = (centers.join(_bcast(means, n_bytes), [col, "cluster"], "left")
           .select(col, "cluster", F.coalesce("_new", "center").alias("center")))
    if dealt is not points:
        out = checkpointed(out)
        dealt.release()
    return out


def local_kmeans(points: DataFrame, k: int, steps: int = 10, order: str = "row_id",
                 col: str = BLOCK, init: str | DataFrame = "farthest", tol: float = 0.0,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """K5 (k-means): ``block_id, cluster, center`` once no center moves by more
    than ``tol``, or after ``steps`` steps.

    ``init``: ``"farthest"`` (farthest-first from the lowest id),
    ``"lowest"`` (the k lowest ids), ``"oversampled"`` (``init_oversampled``, for many
    centers or outliers) or a center table; all repeatable.
    A block that fits one chunk takes all its steps in one job.
    """
    if not isinstance(init, DataFrame) and init not in ("lowest", "farthest", "oversampled"):
        raise ValueError("init must be 'farthest', 'lowest', 'oversampled' or a DataFrame")
    given = init if isinstance(init, DataFrame) else None
    dealt = deal(points.select(F.col(col).cast("int").alias(col), order, "features"), order, col, chunk_rows)
    if isinstance(init, str) and init == "oversampled":
        given = init_oversampled(dealt, k, order, col)
    whole, large = dealt.split()
    out = checkpointed(kmeans_whole(whole, given, k, steps, order, init == "farthest" if given is None else False, tol))
    if large.any():
        mine = F.broadcast(large.sizes.select(col))
        start = given if given is not None else (
            init_lowest(large, k, order, col) if init == "lowest" else init_farthest(large, k, order, col))
        centers = checkpointed(start.join(mine, col, "left_semi"))
        n = center_bytes(centers)
        for _ in range(steps):
            old = centers.withColumnRenamed("center", "_old")
            centers = checkpointed(lloyd_step(large, centers, n, col))
            far = centers.join(old, [col, "cluster"]).agg(F.max(sq_distance(F.col("center"), F.col("_old")))).first()[0]
            if far is None or far <= tol * tol:
                break
        out = checkpointed(out.unionByName(centers.select(*out.columns)))
    dealt.release()              # the centers are checkpointed
    return out


def local_bisecting(points: DataFrame, k: int, block_ids: Sequence[int] | None = None, seed: int = 1,
                    parallelism: int = 4, col: str = BLOCK, max_iter: int = 20, order: str = "row_id",
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """K5 (bisecting k-means): ``block_id, cluster, center``.  The largest
    leaves of every block are cut in two until it has k, all blocks together.
    Starts are farthest points, so nothing is drawn: ``seed`` and
    ``parallelism`` are kept for callers and have no effect."""
    pts = points if block_ids is None else points.filter(F.col(col).isin([int(b) for b in block_ids]))
    dealt = deal(pts.select(F.col(col).cast("int").alias(col), order, "features"), order, col, chunk_rows)
    whole, large = dealt.split()
    out = checkpointed(bisect_whole(whole, k, order, max_iter))
    if large.any():
        out = checkpointed(out.unionByName(bisect_large(large, k, order, max_iter)))
    dealt.release()
    # leaves in the order of the tree
    depth = F.log2("node").cast("int")
    place = F.col("node") / F.pow(F.lit(2.0), depth)
    return out.select(col, (F.row_number().over(Window.partitionBy(col).orderBy(place, "node")) - 1).alias("cluster"), "center")


# ---------------------------------------------------------------------- K6, K7
def pooled_centers(local: DataFrame, k: int, col: str = BLOCK) -> DataFrame:
    """K6: every local center becomes one point ``point_id = block*k + c``."""
    return local.select((F.col(col) * F.lit(int(k)) + F.col("cluster")).alias("point_id"),
                        F.col("center").alias("features"))


def fit_centers(points: DataFrame, k: int, algo: str = "kmeans", seed: int = 1,
                max_iter: int = 20):
    """K1/K2/K7: MLlib KMeans or bisecting k-means (``bisecting``, with MLlib's model) on
    ``features``.  Returns (model, centers DataFrame ``center_id, center``)."""
    if algo not in ("kmeans", "bisectingkmeans"):
        raise ValueError("algo must be 'kmeans' or 'bisectingkmeans'")
    if algo == "bisectingkmeans":
        model = fit_bisecting(points, k, seed, max_iter)
    else:
        from pyspark.ml.clustering import KMeans
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="vec").fit(
            points.withColumn("vec", array_to_vector("features")))
    return model, model_centers(points.sparkSession, model)


def model_centers(spark, model) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "center_id INT, center ARRAY<DOUBLE>")


def two_level(points: DataFrame, k: int, algo: str, block_ids: Sequence[int], steps: int = 10,
              seed: int = 1, parallelism: int = 4, col: str = BLOCK, init: str = "farthest"):
    """K5 + K6 + K7: local centers per block, pooled, clustered again.
    Returns (model, final centers, local centers)."""
    pts = points.filter(F.col(col).isin([int(b) for b in block_ids]))
    if algo == "kmeans":
        local = local_kmeans(pts, k, steps, col=col, init=init)
    else:
        local = local_bisecting(pts, k, block_ids, seed, parallelism, col)
    model, centers = fit_centers(pooled_centers(local, k, col), k, algo, seed)
    return model, centers, local


# ---------------------------------------------------------------------- K8-K10
def _with_nearest(points: DataFrame, vec: str, centers: DataFrame, center_id: str, limit: int) -> DataFrame:
    """points with ``_best`` = (distance, center) of the nearest center (ties ->
    lowest id).  The centers go to the tasks in groups of up to ``limit`` bytes;
    each keeps the best so far, in one pass over the points and without a shuffle."""
    groups = max(1, -(-center_bytes(centers) // limit))
    kind = centers.schema[center_id].dataType
    out = points.withColumn("_d", F.lit(None).cast("double")).withColumn("_c", F.lit(None).cast(kind))
    schema, at = out.schema, points.columns.index(vec)
    for g in range(groups):
        part = centers if groups == 1 else centers.filter(F.pmod(F.xxhash64(center_id), F.lit(groups)) == g)
        table = part.select(F.col(center_id).alias("c"), "center").orderBy("c").toArrow()
        if not len(table):
            continue
        ids, where = table["c"].combine_chunks(), matrix(table["center"])

        def run(batches, ids=ids, where=where):
            for batch in batches:
                cols = batch.columns
                real = np.flatnonzero(cols[at].is_valid().to_numpy(zero_copy_only=False))
                x = matrix(pa.chunked_array([cols[at].take(pa.array(real))]))
                if len(real):
                    best = nearest(x, where)
                    d = np.full(len(batch), np.nan)
                    d[real] = distances(x, where[best])
                    to = np.zeros(len(batch), np.int64)
                    to[real] = best
                    new_d, new_c = pa.array(d, mask=np.isnan(d)), ids.take(pa.array(to, mask=np.isnan(d)))
                    old_d, old_c = cols[-2], cols[-1]
                    closer = pc.or_kleene(pc.is_null(old_d), pc.or_kleene(pc.less(new_d, old_d), pc.and_kleene(
                        pc.equal(new_d, old_d), pc.less(new_c, old_c)))).fill_null(False)
                    cols[-2:] = [pc.if_else(closer, new_d, old_d), pc.if_else(closer, new_c, old_c)]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out.withColumn("_best", F.struct(F.col("_d").alias("d"), F.col("_c").alias("c"))).drop("_d", "_c")


def assign_nearest(points: DataFrame, centers: DataFrame, out: str = "cluster",
                   center_id: str = "center_id", limit: int = BROADCAST_CENTERS) -> DataFrame:
    """Nearest of a global center table (``center_id, center``)."""
    return (_with_nearest(points, "features", centers, center_id, limit)
            .withColumn(out, F.col("_best.c")).drop("_best"))


def center_error(true_centers: DataFrame, predicted: DataFrame, limit: int = BROADCAST_CENTERS) -> DataFrame:
    """K8: for each true center the least squared distance to any predicted
    center, summed (extra predicted centers cost nothing).  One row."""
    near = _with_nearest(true_centers.select(F.col("center").alias("_v")), "_v",
                         predicted.select("center", F.hash("center").alias("_id")), "_id", limit)
    return near.agg(F.sum("_best.d").alias("distance"))


def purity(assigned: DataFrame, cluster: str = "cluster", label: str = "label",
           col: str = BLOCK) -> DataFrame:
    """K9: per block, sum over clusters of the largest label count, over
    the block's rows.  ``block_id, n_rows, purity``."""
    counts = assigned.groupBy(col, cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    per_cluster = counts.groupBy(col, cluster).agg(F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    return (per_cluster.groupBy(col)
            .agg(F.sum("_all").alias("n_rows"), F.sum("_top").alias("_top"))
            .select(col, "n_rows", (F.col("_top") / F.col("n_rows")).alias("purity")))


def mean_purity(per_block: DataFrame) -> DataFrame:
    """Unweighted mean of the block purities."""
    return per_block.agg(F.avg("purity").alias("mean_purity"), F.count(F.lit(1)).alias("n_blocks"))
