"""Clustering runs: exact arm with a plan table (K3) or shuffled blocks (K4),
block arm with a plan table (K11) or shuffled blocks (K12).

Every run returns one row per size: ``size, arm, n_train_blocks,
distance, purity`` (purity NULL when there is no test set).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import cluster as K


def _row(spark, size, arm, n_train, dist_df, purity_df):
    d = dist_df.first()["distance"]
    p = purity_df.first()["mean_purity"] if purity_df is not None else None
    return spark.createDataFrame([(int(size), arm, int(n_train), float(d), p)],
                                 "size INT, arm STRING, n_train_blocks INT, distance DOUBLE, purity DOUBLE")


def _exact_one(rows, true_centers, k, algo, frac, seed, size, n_blocks, model_path=None):
    if 0 < frac < 1:
        # by a hash of the row id: the same split at every partitioning, and after a lost executor
        tagged = B.hash_split(rows, "row_id", frac, seed)
        train, test = (tagged.filter(F.col("role") == r).drop("role") for r in ("train", "test"))
    else:
        train, test = B.random_split(rows, frac, seed)
    model, centers = K.fit_centers(train, k, algo, seed)
    if model_path:
        model.write().overwrite().save(f"{model_path}/size={size}")       # S8
    dist = K.center_error(true_centers, centers)
    pur = None
    if test is not None:
        pur = K.mean_purity(K.purity(K.assign_nearest(test, centers)))
    return _row(rows.sparkSession, size, f"exact-{algo}", n_blocks, dist, pur)


def exact_with_plan(points: DataFrame, plan: DataFrame, sizes: Sequence[int], true_centers: DataFrame,
                    k: int, algo: str = "kmeans", frac: float = 0.9, seed: int = 1,
                    model_path: str | None = None) -> DataFrame:
    """K3: blocks for each size from the plan (default ``range(size)``),
    random row split, one MLlib fit, center error and purity.  No sizes:
    one run on the whole table (reported as size 0)."""
    if not sizes:
        n_b = points.select(B.BLOCK).distinct().count()
        return _union([_exact_one(points, true_centers, k, algo, frac, seed, 0, n_b, model_path)])
    out = []
    for s in sizes:
        rows = B.blocks_by_plan(points, plan, [s]).drop("size")
        n_b = rows.select(B.BLOCK).distinct().count()
        out.append(_exact_one(rows, true_centers, k, algo, frac, seed, s, n_b, model_path))
    return _union(out)


def exact_shuffled(points: DataFrame, n_total: int, sizes: Sequence[int], true_centers: DataFrame,
                   k: int, unit: float, algo: str = "kmeans", frac: float = 0.9, seed: int = 1,
                   model_path: str | None = None) -> DataFrame:
    """K4: ``int(size * unit)`` random blocks per size, split, fit, score.  No
    sizes, and a size of no blocks, mean the whole table; models are saved
    below ``model_path``."""
    out = []
    for s in sizes or [0]:
        n = B.blocks_for_unit(s, unit)
        rows = B.random_blocks(points, n_total, n, f"{seed}:{s}") if n else points
        out.append(_exact_one(rows, true_centers, k, algo, frac, seed, s, n or n_total, model_path))
    return _union(out)


def _block_one(points, train_ids, test_ids, true_centers, k, algo, steps, seed, size):
    model, centers, _ = K.two_level(points, k, algo, train_ids, steps, seed)
    dist = K.center_error(true_centers, centers)
    pur = None
    if test_ids:
        test = B.blocks_by_ids(points, test_ids)
        pur = K.mean_purity(K.purity(K.assign_nearest(test, centers)))
    return _row(points.sparkSession, size, f"blocks-{algo}", len(train_ids), dist, pur)


def blocks_with_plan(points: DataFrame, plan: DataFrame, sizes: Sequence[int], true_centers: DataFrame,
                     k: int, subs: float, tests: int, algo: str = "kmeans", steps: int = 10,
                     seed: int = 1) -> DataFrame:
    """Plan ids (default ``range(size + tests)``); the first
    ``max(1, int(len * subs))`` train, the next ``tests`` ids test.  No
    sizes: train on every block, test on blocks ``0 .. tests-1``."""
    if not sizes:
        ids = sorted(r[0] for r in points.select(B.BLOCK).distinct().collect())   # one per block
        return _union([_block_one(points, ids, list(range(tests)), true_centers, k, algo, steps, seed, 0)])
    asked = plan.filter(F.col("size").isin([int(s) for s in sizes])).collect()   # one row a size
    plan_rows = {int(r["size"]): list(r["block_ids"]) for r in asked}
    every = None
    out = []
    for s in sizes:
        ids = plan_rows.get(int(s), list(range(int(s) + tests)) if s else [])
        if not ids:  # the whole table
            every = every or sorted(r[0] for r in points.select(B.BLOCK).distinct().collect())  # one per block
            out.append(_block_one(points, every, list(range(tests)), true_centers, k, algo, steps, seed, s))
            continue
        t = B.train_block_count(len(ids), subs)
        out.append(_block_one(points, ids[:t], ids[t:t + tests], true_centers, k, algo, steps, seed, s))
    return _union(out)


def blocks_shuffled(points: DataFrame, n_total: int, sizes: Sequence[int], true_centers: DataFrame,
                    k: int, subs: float, tests: int, unit: float, algo: str = "kmeans", steps: int = 10,
                    seed: int = 1) -> DataFrame:
    """``max(1, int(size * unit * subs))`` random train blocks and the
    next ``tests`` as test blocks; ``tests = 0`` skips purity.  No sizes, and
    size 0, mean training on every block and testing on the first ``tests``."""
    out = []
    for s in sizes or [0]:
        if not s:
            perm = list(range(n_total))
            out.append(_block_one(points, perm, perm[:tests], true_centers, k, algo, steps, seed, s))
            continue
        t = max(1, int(s * unit * subs))
        perm = B.shuffled_block_ids(n_total, f"{seed}:{s}")
        out.append(_block_one(points, perm[:t], perm[t:t + tests], true_centers, k, algo, steps, seed, s))
    return _union(out)


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("distance", F.round("distance", 6))
