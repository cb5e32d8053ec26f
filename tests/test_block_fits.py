"""Learners of all blocks together: one chunk or many give the same models, jobs do
not grow with the blocks, and small models agree with brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import block_linear as L
from tessera.operators import block_trees as T
from tessera.operators import blocks as B
from tessera.operators import ensemble as E
from tessera.plans import clf_runs


def _rows(spark, n=900, blocks=3, classes=3, d=4, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rnd.randrange(6)) for _ in range(d)]
        y = (int(x[0] > 2) + int(x[1] + x[2] > 5)) if rnd.random() < 0.85 else rnd.randrange(classes)
        rows.append((i, i % blocks, y, "validate" if i % 10 == 9 else "train", x))
    return rows, B.materialise(spark.createDataFrame(rows, "row_id LONG, block_id INT, y INT, role STRING, features ARRAY<DOUBLE>"))


def _brute_tree(x, y, classes, depth, node=1):
    """Greedy Gini tree over all midpoints: {node: (feature, cut, left class, right class)}."""
    out, best = {}, None
    total = np.bincount(y, minlength=classes)
    if depth == 0 or total.max() == len(y):
        return out
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            a, b = (np.bincount(y[s], minlength=classes).astype(float) for s in (left, ~left))
            score = (a * a).sum() / a.sum() + (b * b).sum() / b.sum()
            if score - (total * total).sum() / len(y) > len(y) * 1e-12 and (best is None or score > best[0]):
                best = (score, f, float(cut), int(a.argmax()), int(b.argmax()), left)
    if best is None:
        return out
    _, f, cut, lp, rp, left = best
    out[node] = (f, cut, lp, rp)
    return out | _brute_tree(x[left], y[left], classes, depth - 1, 2 * node) | _brute_tree(x[~left], y[~left], classes, depth - 1, 2 * node + 1)


@pytest.mark.parametrize("chunk_rows", [20_000, 60])
def test_trees_by_brute_force(spark, chunk_rows):
    rows, df = _rows(spark)
    fit = T.fit_forests(df, T.TreeSettings.of("DT", 4, maxDepth=4), 4, 3, chunk_rows=chunk_rows)
    got = {}
    for r in fit.nodes.filter("feature is not null").collect():
        got.setdefault(r.block_id, {})[r.node] = (r.feature, r.cut, r.lpred, r.rpred)
    hits = {}
    for b in range(3):
        mine = [r for r in rows if r[1] == b and r[3] == "train"]
        tree = _brute_tree(np.array([r[4] for r in mine]), np.array([r[2] for r in mine]), 3, 4)
        assert got[b] == tree
        for r in (r for r in rows if r[1] == b and r[3] == "validate"):
            node, pred = 1, 0
            while node in tree:
                f, cut, lp, rp = tree[node]
                right = r[4][f] > cut
                node, pred = 2 * node + right, rp if right else lp
            hits.setdefault(b, []).append(pred == r[2])
    assert {r.model_id: (r.n_validate, r.accuracy) for r in fit.accuracy.collect()} == {
        b: (len(h), sum(h) / len(h)) for b, h in hits.items()}


def test_forests_by_chunks(spark):
    _, df = _rows(spark)
    s = T.TreeSettings.of("RF", 4, 7, numTrees=4, maxDepth=5)
    cols = ["block_id", "tree", "node", "level", "pred", "feature", "cut", "lpred", "rpred"]
    one, many = (sorted(map(tuple, T.fit_forests(df, s, 4, 3, chunk_rows=c).nodes.select(*cols).collect()), key=repr) for c in (20_000, 60))
    assert one == many and len({r[1] for r in one}) == 4


@pytest.mark.parametrize("algo,classes", [("LR", 2), ("LR", 3), ("SVM", 2), ("SVM", 3)])
def test_sums_by_finite_differences(algo, classes):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, classes, 40)
    s, heads = L.LinearSettings(algo), 1 if classes == 2 else classes
    theta = rng.normal(size=(heads, 4))
    v = L._sums(s, x, y, theta)
    g = v[2:2 + heads * 4].reshape(heads, 4)
    for k in range(heads):
        for j in range(4):
            step = np.zeros_like(theta)
            step[k, j] = 1e-6
            slope = (L._sums(s, x, y, theta + step)[1] - L._sums(s, x, y, theta - step)[1]) / 2e-6
            assert g[k, j] == pytest.approx(slope, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("algo", ["LR", "SVM"])
def test_planes_by_chunks(spark, algo):
    _, df = _rows(spark)
    s = L.LinearSettings.of(algo, tol=1e-10)
    one, many = (L.fit_planes(df, s, 4, 3, chunk_rows=c) for c in (20_000, 60))
    a, b = ({r.block_id: (r.best, r.loss) for r in m.theta.collect()} for m in (one, many))
    assert a.keys() == b.keys() == {0, 1, 2}
    for k in a:
        assert a[k][1] == pytest.approx(b[k][1], rel=1e-9) and np.allclose(a[k][0], b[k][0], atol=1e-4)
    assert sorted(map(tuple, one.accuracy.collect())) == sorted(map(tuple, many.accuracy.collect()))


def test_logistic_regression_finds_the_minimum(spark):
    """The optimum of MLlib's solver on the same block."""
    from pyspark.ml.classification import LogisticRegression
    rows, _ = _rows(spark, blocks=1)
    df = spark.createDataFrame([(r[0], 0, min(r[2], 1), "train", r[4]) for r in rows], "row_id LONG, block_id INT, y INT, role STRING, features ARRAY<DOUBLE>")
    got = L.fit_planes(df, L.LinearSettings.of("LR", tol=1e-12), 4, 2).theta.first().best
    m = LogisticRegression(labelCol="y", featuresCol="vec", maxIter=200, tol=1e-12).fit(E.with_vector(df))
    assert np.allclose(got, [*m.coefficients, m.intercept], atol=1e-4)


@pytest.mark.parametrize("algo", ["DT", "LR"])
def test_jobs_do_not_grow_with_the_blocks(spark, algo):
    sc = spark.sparkContext
    jobs = []
    for blocks in (4, 60):
        _, df = _rows(spark, n=1200, blocks=blocks, classes=2)
        df = df.withColumnRenamed("y", "label")
        df.count()
        sc.setJobGroup(f"fit-{algo}-{blocks}", "")
        E.fit_together(df, algo, [0, 1, 2], maxDepth=3) if algo == "DT" else E.fit_together(df, algo, [0, 1, 2], maxIter=5)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit-{algo}-{blocks}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_votes_in_parts(spark):
    rows, df = _rows(spark)
    df = df.withColumnRenamed("y", "label")
    models = E.fit_together(df, "DT", [0, 1, 2], maxDepth=4)
    whole = E.vote_counts(models, df)
    parts = E.vote_counts(models, df, limit=1)              # a pass a model
    assert whole.columns == parts.columns == [*df.columns, "votes"]
    assert sorted((r.row_id, tuple(r.votes)) for r in whole.collect()) == sorted((r.row_id, tuple(r.votes)) for r in parts.collect())
    assert whole.filter(F.aggregate("votes", F.lit(0), lambda a, v: a + v) != 3).count() == 0


def test_labels_blocks_and_rows_at_the_edge(spark):
    """Labels that are not 0..k, null labels, a block of one label, one without training rows."""
    rows = [(i, i % 3, None if i % 50 == 49 else (7 if i % 3 == 1 or i % 2 else -4), [float(i % 2), 0.5]) for i in range(300)]
    rows += [(1000, 9, 7, [1.0, 0.5])]
    v = spark.createDataFrame(rows, "row_id LONG, block_id INT, label INT, features ARRAY<DOUBLE>")
    for algo in ("DT", "RF", "LR", "SVM"):
        res = clf_runs.block_ensemble(v, v.filter("label is not null"), algo, tail=0.0, seed=3)
        assert {r.prediction for r in res.votes.collect()} <= {7, -4}
        assert res.accuracy.filter("model_id < 8").count() >= 3
    assert E.voted(E.fit_together(B.holdout_in_block(v, "row_id"), "DT", [-4, 7]), v.limit(0)).collect() == []


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_cut_by_counting(spark, fraction):
    rnd = random.Random(5)
    ids = rnd.sample(range(-10**13, 10**13), 700)
    rows = [(i, 0 if k % 7 else k % 5) for k, i in enumerate(ids)] + [(3 * 10**13, 8)]
    df = spark.createDataFrame(rows, "row_id LONG, block_id INT")
    got = {r.block_id: (r.n, r.nth) for r in B.nth_in_group(df, "block_id", "row_id", fraction, cells=100).collect()}
    for b in {b for _, b in rows}:
        mine = sorted(i for i, k in rows if k == b)
        want = int(np.floor(fraction * len(mine)))
        assert got[b] == (len(mine), mine[want - 1] if want else None)
    plan = B.holdout_in_block(df, "row_id", fraction)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("algo", ["RF", "LR"])
def test_saved_ensemble(spark, tmp_path, algo):
    _, df = _rows(spark)
    df = df.withColumnRenamed("y", "label")
    models = E.fit_together(df, algo, [0, 1, 2], **({"numTrees": 3} if algo == "RF" else {}))
    models.keep(models.accuracy.filter("model_id < 2")).save(f"file://{tmp_path}/ensemble")
    back = E.BlockModels.load(spark, f"file://{tmp_path}/ensemble")
    assert [m.block_id for m in back] == [0, 1] and back.accuracy.count() == 3 and back.labels == [0, 1, 2]
    want, got = (sorted((r.row_id, r.prediction) for r in E.voted(m, df).collect()) for m in (models.keep(models.accuracy.filter("model_id < 2")), back))
    assert want == got
