"""Clustering operators: hand-worked cases (FIXTURES.md 3.5, 3.6) and
block-local k-means on well separated synthetic clusters."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import cluster as K
from tessera.plans import clt_runs
from tessera.sources import true_centers


def test_center_error(spark):
    t = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "center_id INT, center ARRAY<DOUBLE>")
    p = spark.createDataFrame([(0, [0.0, 1.0]), (1, [3.0, 4.0]), (2, [9.0, 9.0])],
                              "center_id INT, center ARRAY<DOUBLE>")
    assert K.center_error(t, p).first().distance == pytest.approx(1.0)


def test_purity(spark):
    rows = [(0, "a", 0), (0, "a", 0), (0, "a", 1), (0, "b", 1), (1, "a", 0), (1, "a", 0)]
    df = spark.createDataFrame(rows, "block_id INT, cluster STRING, label INT")
    per = {r.block_id: r.purity for r in K.purity(df).collect()}
    assert per == {0: 0.75, 1: 1.0}
    assert K.mean_purity(K.purity(df)).first().mean_purity == pytest.approx(0.875)


def _blobs(spark, n=900, blocks=3, seed=2):
    rnd = random.Random(seed)
    centers = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = []
    for i in range(n):
        c = rnd.randrange(3)
        x, y = centers[c]
        rows.append((i, c, [x + rnd.gauss(0, 0.3), y + rnd.gauss(0, 0.3)]))
    df = spark.createDataFrame(rows, "row_id LONG, label INT, features ARRAY<DOUBLE>")
    return B.materialise(B.assign_blocks(df, "row_id", blocks, 4))


def test_local_kmeans_and_two_level(spark):
    v = _blobs(spark)
    loc = K.local_kmeans(v, 3, steps=10)
    assert loc.count() == 9
    _, centers, _ = K.two_level(v, 3, "kmeans", [0, 1, 2], steps=10, seed=1)
    err = K.center_error(true_centers(v), centers).first().distance
    assert err < 0.1
    assigned = K.assign_nearest(v, centers)
    assert K.mean_purity(K.purity(assigned)).first().mean_purity > 0.99


def test_init_and_empty_cluster(spark):
    v = _blobs(spark, n=60)
    init = K.init_lowest(v, 2)
    low = {r.block_id: r.features for r in v.groupBy("block_id").agg(F.min_by("features", "row_id").alias("features")).collect()}
    for r in init.filter("cluster = 0").collect():
        assert r.center == low[r.block_id]
    # a far-away initial center attracts no point and keeps its place
    far = init.withColumn("center", F.when(F.col("cluster") == 1, F.array(F.lit(1e6), F.lit(1e6)))
                          .otherwise(F.col("center")))
    step = K.lloyd_step(v, far, far.count())
    assert step.filter("cluster = 1").filter(F.col("center")[0] == 1e6).count() == step.filter("cluster = 1").count()


def test_bisecting_and_runs(spark):
    v = _blobs(spark)
    loc = K.local_bisecting(v, 3, [0, 1, 2], seed=1, parallelism=2)
    assert loc.count() == 9
    tc = true_centers(v)
    plan = spark.createDataFrame([(2, [0, 2])], "size INT, block_ids ARRAY<INT>")
    ex = clt_runs.exact_with_plan(v, plan, [2, 1], tc, 3, "kmeans")
    assert ex.count() == 2 and ex.filter("distance > 1").count() == 0
    bl = clt_runs.blocks_shuffled(v, 3, [2], tc, 3, subs=1.0, tests=1, unit=1.0, algo="bisectingkmeans")
    r = bl.first()
    assert r.n_train_blocks == 2 and r.purity > 0.99
    no_test = clt_runs.blocks_shuffled(v, 3, [2], tc, 3, subs=1.0, tests=0, unit=1.0)
    assert no_test.first().purity is None


def test_runs_without_sizes_use_whole_table(spark):
    v = _blobs(spark, n=300)
    tc = true_centers(v)
    plan = spark.createDataFrame([], "size INT, block_ids ARRAY<INT>")
    ex = clt_runs.exact_with_plan(v, plan, [], tc, 3, "kmeans")
    assert ex.first().size == 0 and ex.first().n_train_blocks == 3
    bl = clt_runs.blocks_with_plan(v, plan, [], tc, 3, subs=1.0, tests=1)
    assert bl.first().n_train_blocks == 3 and bl.first().purity is not None


def test_shuffled_exact_and_planned_block_runs(spark):
    v = _blobs(spark, n=600, blocks=4)
    tc = true_centers(v)
    ex = clt_runs.exact_shuffled(v, 4, [2, 4], tc, 3, unit=1.0, algo="kmeans", seed=1)
    got = {r.size: r for r in ex.collect()}
    assert set(got) == {2, 4} and got[4].n_train_blocks == 4
    assert all(r.distance < 0.5 for r in got.values())
    plan = spark.createDataFrame([(2, [0, 3, 1])], "size INT, block_ids ARRAY<INT>")
    bl = clt_runs.blocks_with_plan(v, plan, [2, 3], tc, 3, subs=0.67, tests=1, algo="kmeans", steps=5)
    rows = {r.size: r for r in bl.collect()}
    assert rows[2].n_train_blocks == 2            # plan ids [0, 3, 1]: int(3 * 0.67) = 2 train, 1 test
    assert rows[3].n_train_blocks == 2            # default range(0, 3 + 1): int(4 * 0.67) = 2
    assert all(r.purity is not None and r.purity > 0.95 for r in rows.values())


def test_shuffled_runs_without_sizes(spark, tmp_path):
    from pyspark.ml.clustering import KMeansModel
    v = _blobs(spark)
    tc = true_centers(v)
    path = f"file://{tmp_path}/models"
    for sizes in ([], [0]):
        ex = clt_runs.exact_shuffled(v, 3, sizes, tc, 3, unit=1.0, model_path=path).collect()
        assert [(r["size"], r["n_train_blocks"]) for r in ex] == [(0, 3)]
        bl = clt_runs.blocks_shuffled(v, 3, sizes, tc, 3, subs=1.0, tests=1, unit=1.0).collect()
        assert [(r["size"], r["n_train_blocks"]) for r in bl] == [(0, 3)]
    assert len(KMeansModel.load(f"{path}/size=0").clusterCenters()) == 3


def test_lloyd_stops_when_nothing_moves(spark, monkeypatch):
    v = _blobs(spark)
    calls = []
    step = K.lloyd_step
    monkeypatch.setattr(K, "lloyd_step", lambda *a: calls.append(1) or step(*a))
    a = sorted(map(tuple, K.local_kmeans(v, 3, steps=40).select("block_id", "cluster").collect()))
    assert len(calls) < 20 and len(a) == 9


def test_centers_in_groups_equal_one_broadcast(spark):
    pts = spark.range(300).select(F.col("id").alias("row_id"),
                                  F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("features"))
    centers = spark.range(20).select(F.col("id").cast("int").alias("center_id"),
                                     F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("center"))
    one = {tuple(r) for r in K.assign_nearest(pts, centers).select("row_id", "cluster").collect()}
    assert {tuple(r) for r in K.assign_nearest(pts, centers, limit=400).select("row_id", "cluster").collect()} == one
    truth = pts.select(F.col("features").alias("center")).distinct()
    assert K.center_error(truth, centers).first() == K.center_error(truth, centers, limit=400).first()
