"""Ensemble operators: hand-worked cases (FIXTURES.md 3.2-3.4) and fits on
separable synthetic vectors."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import ensemble as E
from tessera.plans import clf_runs


@pytest.mark.parametrize("acc,tail,kept", [
    ([0.5, 0.6, 0.7, 0.8, 0.9], 0.2, [0.6, 0.7, 0.8]),
    ([0.5, 0.5, 0.7, 0.9, 0.9], 0.0, [0.5, 0.5, 0.7, 0.9, 0.9]),
    ([0.6, 0.8], 0.1, [0.6, 0.8]),
])
def test_trim(spark, acc, tail, kept):
    df = spark.createDataFrame(list(enumerate(acc)), "model_id INT, accuracy DOUBLE")
    got = sorted(r.accuracy for r in E.trim(df, tail).filter("kept").collect())
    assert got == kept
    assert E.trim(df, tail, enabled=False).filter("kept").count() == len(acc)


@pytest.mark.parametrize("preds,want", [([1, 0, 1], 1), ([0, 1], 0), ([2, 2, 1, 1, 0], 1)])
def test_vote(spark, preds, want):
    df = spark.createDataFrame([(1, preds)], "row_id LONG, predictions ARRAY<INT>")
    assert E.vote(df).first().prediction == want
    long = spark.createDataFrame([(1, p) for p in preds], "row_id LONG, prediction INT")
    assert E.vote_long(long).first().prediction == want


def test_weighted_accuracy(spark):
    rows = [(0, 1, 1)] * 10 + [(1, 1, 1)] * 15 + [(1, 0, 1)] * 15
    df = spark.createDataFrame(rows, "block_id INT, label INT, prediction INT")
    per, tot = E.weighted_accuracy(df)
    accs = {r.block_id: r.accuracy for r in per.collect()}
    assert accs == {0: 1.0, 1: 0.5}
    assert tot.first().accuracy == pytest.approx(0.625)


def _separable(spark, n=1200, blocks=6, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        base = 2.0 if y else -2.0
        rows.append((i, y, [base + rnd.gauss(0, 0.5), rnd.gauss(0, 1), -base + rnd.gauss(0, 0.5)]))
    df = spark.createDataFrame(rows, "row_id LONG, label INT, features ARRAY<DOUBLE>")
    return B.materialise(B.assign_blocks(df, "row_id", blocks, 1))


@pytest.mark.parametrize("algo", ["DT", "LR", "RF", "SVM"])
def test_block_ensemble_learns(spark, algo):
    v = _separable(spark)
    tr, te = B.split_blocks(v, 6, 4, 2, 5)
    res = clf_runs.block_ensemble(tr, te, algo, tail=0.2, seed=1, parallelism=2)
    assert res.total.first().accuracy > 0.95
    assert res.accuracy.count() == (32 if algo == "SVM" else 4)   # B11: 8 sub-blocks per block


def test_train_only_and_single_class(spark):
    v = _separable(spark)
    res = clf_runs.block_ensemble(B.blocks_by_ids(v, [0, 1]), None, "DT", seed=1)
    assert res.votes is None and res.accuracy.count() == 2          # C8
    one_class = v.withColumn("label", F.when(F.col("block_id") == 0, F.lit(0)).otherwise(F.col("label")))
    models, skipped = E.fit_blocks(E.with_vector(one_class).drop("vec"), lambda: E.estimator_for("LR"),
                                   [0, 1], needs_two_classes=True)
    # a block of one label gets a model that predicts it; only a block without rows is skipped
    assert skipped == [] and [m.block_id for m in models] == [0, 1]
    assert {r.predictions[0] for r in E.score_models(models, v).select("predictions").collect()} == {0}
    assert E.fit_blocks(one_class, lambda: E.estimator_for("LR"), [0, 99], needs_two_classes=True)[1] == [99]


def test_score_models_one_pass(spark):
    v = _separable(spark)
    models, _ = E.fit_blocks(v, lambda: E.estimator_for("DT"), [0, 1, 2])
    scored = E.score_models(models, v)
    assert scored.columns == v.columns + ["predictions"]
    assert scored.filter(F.size("predictions") != 3).count() == 0
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_multi_site_single_and_exact(spark):
    v = _separable(spark)
    train, test = v.filter("block_id < 4"), v.filter("block_id >= 4")   # the sites never see the test blocks
    sites = [(B.assign_blocks(train.drop("block_id"), "row_id", 3, s), a) for s, a in ((1, "DT"), (2, "LR"))]
    _, final, tot = clf_runs.multi_site(sites, test, 3, 0.2, seed=1)
    assert final.count() == test.count() and tot.first().accuracy > 0.95
    assert "Exchange" not in final._jdf.queryExecution().executedPlan().toString()   # in-row votes
    _, acc = clf_runs.single_model(v, "DT", seed=1)
    assert acc.first().accuracy > 0.9
    pred = clf_runs.exact(v.filter("block_id < 4"), v.filter("block_id >= 4"), "LR")
    assert E.weighted_accuracy(pred)[1].first().accuracy > 0.95


def test_score_models_groups(spark):
    v = _separable(spark)
    models, _ = E.fit_blocks(v, lambda: E.estimator_for("DT"), [0, 1, 2, 3, 4])
    one = E.score_models(models, v).select("row_id", "predictions")
    grouped = E.score_models(models, v, group=2).select("row_id", "predictions")
    assert one.exceptAll(grouped).count() == 0
    assert grouped.filter(F.size("predictions") != 5).count() == 0


def test_fit_blocks_in_a_scheduler_pool(spark):
    v = _separable(spark)
    models, _ = E.fit_blocks(v, lambda: E.estimator_for("DT"), [0, 1], pool="blocks")
    assert [m.block_id for m in models] == [0, 1]


def test_settings_and_own_learner(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    v = _separable(spark)
    assert E.estimator_for("DT").getMaxDepth() == E.estimator_for("RF").getMaxDepth() == 20
    res = clf_runs.block_ensemble(v, None, "DT", maxDepth=1)
    assert all(m.model.depth <= 1 for m in res.models)
    own = clf_runs.block_ensemble(v, None, "DT", make_estimator=lambda: DecisionTreeClassifier(
        labelCol="label", featuresCol="vec", maxDepth=0))
    assert all(m.model.numNodes == 1 for m in own.models)
