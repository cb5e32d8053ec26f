"""Bisecting k-means of all rows: MLlib's tree, fewer passes."""
import numpy as np
import pytest
from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel
from pyspark.ml.functions import array_to_vector

from tessera.operators import bisecting as T
from tessera.operators import blocks as B
from tessera.operators import cluster as K


def _frame(spark, x, parts=8):
    return B.materialise(spark.createDataFrame([(r,) for r in x.tolist()], "features array<double>").repartition(parts))


def _groups(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.2, (n, 2)) + np.array([(0, 0), (9, 1), (1, 8), (20, 20)])[rng.integers(0, 4, n)]


@pytest.mark.parametrize("d,k,parts", [(2, 7, 8), (5, 10, 1), (3, 40, 3)])
def test_the_tree_is_that_of_mllib(spark, tmp_path, d, k, parts):
    """Overlapping groups, so that the passes end by their number, too."""
    rng = np.random.default_rng(d)
    df = _frame(spark, rng.normal(0, 1, (2000, d)) + rng.integers(0, 8, (2000, 1)) * rng.normal(0, 3, (1, d)), parts)
    vec = df.withColumn("vec", array_to_vector("features"))
    want = BisectingKMeans(k=k, seed=42, maxIter=5, featuresCol="vec").fit(vec)
    got = T.fit_bisecting(df, k, 42, 5)
    assert np.allclose(got.clusterCenters(), want.clusterCenters(), rtol=0, atol=1e-9)
    path = f"file://{tmp_path}/model"
    got.write().overwrite().save(path)
    read = BisectingKMeansModel.load(path)
    assert (read.getK(), read.getSeed(), read.getMaxIter()) == (k, 42, 5)
    a, b = ([r.prediction for r in m.transform(vec).select("prediction").collect()] for m in (read, want))
    assert a == b


def test_a_level_ends_when_no_center_moves(spark):
    """MLlib takes 20 passes a level whatever happens: 40 and more for four groups."""
    sc, df = spark.sparkContext, _frame(spark, _groups(800))
    df.count()
    sc.setJobGroup("bisecting", "")
    model, centers = K.fit_centers(df, 4, "bisectingkmeans", 42)
    jobs = len(sc.statusTracker().getJobIdsForGroup("bisecting"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert centers.count() == 4 and len(model.clusterCenters()) == 4
    assert jobs < 40


def test_many_chunks_give_the_same_tree(spark, monkeypatch):
    df = _frame(spark, _groups(900, 3))
    one = T.bisect(df, 6, 7, 20)
    monkeypatch.setattr(T, "PACK_ROWS", 37)
    many = T.bisect(df, 6, 7, 20)
    assert one.keys() == many.keys()
    for n in one:
        assert one[n][0] == many[n][0]
        assert np.allclose(one[n][1], many[n][1]) and one[n][2] == pytest.approx(many[n][2])
    assert one[1][0] == 900 and all(one[n][0] == sum(one[c][0] for c in (2 * n, 2 * n + 1)) for n in one if 2 * n in one)


def test_equal_points_are_not_cut(spark):
    """Every distinct point is found, also where one holds most rows; costs are exact."""
    at = np.array([(0.1, 0.7), (1.3, 0.2), (0.9, 5.1)])
    x = np.repeat(at, (400, 5, 1), axis=0)
    tree = T.bisect(_frame(spark, x, 5), 8, 1, 20)
    leaves = [n for n in tree if 2 * n not in tree]
    assert sorted(tuple(np.round(tree[n][1], 9)) for n in leaves) == sorted(map(tuple, at))
    assert all(tree[n][2] < 1e-20 for n in leaves)


@pytest.mark.parametrize("rows", [[([1.0],), (None,)], [([1.0],), ([None],)], [([1.0, 2.0],), ([1.0],)], [([1.0],), ([float("nan")],)], []])
def test_rows_that_mllib_refuses(spark, rows):
    with pytest.raises(Exception, match="features must|no rows"):
        T.fit_bisecting(spark.createDataFrame(rows, "features array<double>").coalesce(1), 2)
