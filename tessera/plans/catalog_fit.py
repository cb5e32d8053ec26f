"""Registered queries of *fitted* models with SQL twins.

The points come from ``lineitem`` and follow an exact rule, so that a right
fit has one known answer.  Classification: the first feature is the quantity
in steps of five with a gap at 25, and the label says on which side of the gap a
row lies; any tree, forest or separating plane must then predict the label.
Clustering: a row lies on one of seven points, given by its line number; seven
centers must then be those points, at center error 0 and purity 1.

The ``fit_noisy_*`` queries have a share of wrong labels that grows with the
block, which no learner can follow (one informative feature of two values), so
that accuracies, trimming, weights and purities differ by block; ``fit_center_error``
shifts the true centers by a known step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hash_rank_key
from tessera.operators import blocks as B
from tessera.operators import cluster as K
from tessera.operators import ensemble as E
from tessera.plans import clf_runs, clt_runs
from tessera.plans.catalog_fim import _hash
from tessera.session import apply_defaults, ensure_checkpoint_dir
from tessera.sources import read_table

SEED = 42
N_BLOCKS = 5
N_POINTS = 7
PICKED = B.train_test_block_ids(N_BLOCKS, 3, 2, SEED)   # (train, test) block ids


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rows = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_linenumber", "l_quantity", "l_discount")
    return B.assign_blocks(rows, "row_id", N_BLOCKS, SEED)


def ruled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = (F.col("l_quantity") >= 25).cast("int")
    feats = F.array((F.floor(F.col("l_quantity") / 5) + 10 * high).cast("double"),
                    F.col("l_linenumber").cast("double"), F.round(F.col("l_discount") * 100).cast("double"))
    return B.materialise(_lines(spark, sf_dir).select("row_id", "block_id", high.alias("label"), feats.alias("features")))


def ruled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    feats = F.array((10 * n).cast("double"), (n * n).cast("double"))
    return B.materialise(_lines(spark, sf_dir).select("row_id", "block_id", n.cast("int").alias("label"),
                                                      feats.alias("features")))


def noisy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of 25 the quantity lies on; the label says otherwise for
    (4 + 6 * block) of 100 rows, by a hash of the row."""
    high = (F.col("l_quantity") >= 25).cast("int")
    wrong = (F.pmod(hash_rank_key(f"{SEED}:noise", F.col("row_id")), F.lit(100)) < 4 + 6 * F.col("block_id")).cast("int")
    return B.materialise(_lines(spark, sf_dir).select(
        "row_id", "block_id", (high.bitwiseXOR(wrong)).alias("label"), F.array(high.cast("double"), F.lit(1.0)).alias("features")))


def noisy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven points, labelled with the next point's number for (4 + 6 * block) of
    100 rows."""
    n = F.col("l_linenumber")
    wrong = (F.pmod(hash_rank_key(f"{SEED}:noise", F.col("row_id")), F.lit(100)) < 4 + 6 * F.col("block_id")).cast("int")
    return B.materialise(_lines(spark, sf_dir).select(
        "row_id", "block_id", (n + wrong).cast("int").alias("label"), F.array((10 * n).cast("double"), (n * n).cast("double")).alias("features")))


def _train_test(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    return B.blocks_by_ids(v, PICKED[0]), B.blocks_by_ids(v, PICKED[1])


# ------------------------------------------------------------ classification
def q_fit_block_models(spark, sf):
    """Trees of all blocks, their hold-out accuracy and trim flag; no test rows."""
    return clf_runs.block_ensemble(ruled_rows(spark, sf), None, "DT", tail=0.2, seed=SEED).accuracy


def q_fit_keep_all(spark, sf):
    """C4: trimming off, every model is kept."""
    return clf_runs.block_ensemble(ruled_rows(spark, sf), None, "LR", tail=0.4, trim=False, seed=SEED).accuracy


def q_fit_forest_votes(spark, sf):
    """Forests of the train blocks vote on the test blocks."""
    tr, te = _train_test(ruled_rows(spark, sf))
    return clf_runs.block_ensemble(tr, te, "RF", seed=SEED, numTrees=10, maxDepth=5).votes


def q_fit_svm_blocks(spark, sf):
    """Linear SVMs of 8 sub-blocks a block; accuracy per test block."""
    tr, te = _train_test(ruled_rows(spark, sf))
    return clf_runs.block_ensemble(tr, te, "SVM", seed=SEED).per_block


def q_fit_multi_site(spark, sf):
    """A site of trees and one of logistic regressions, voted on unseen blocks."""
    tr, te = _train_test(ruled_rows(spark, sf))
    sites = [(B.assign_blocks(tr.drop("block_id"), "row_id", 3, SEED + i), algo) for i, algo in ((1, "DT"), (2, "LR"))]
    return clf_runs.multi_site(sites, te, n_train=3, tail=0.2, seed=SEED)[1]


def q_fit_single_model(spark, sf):
    """One tree on nine tenths of the rows, scored on the others."""
    return clf_runs.single_model(ruled_rows(spark, sf), "DT", seed=SEED)[1]


def q_fit_exact_model(spark, sf):
    """One logistic regression on the train blocks, scored on the test blocks."""
    tr, te = _train_test(ruled_rows(spark, sf))
    return clf_runs.exact(tr, te, "LR", seed=SEED)


def q_fit_noisy_models(spark, sf):
    """The trees' accuracies differ by block, so the tails are trimmed."""
    return clf_runs.block_ensemble(noisy_rows(spark, sf), None, "DT", tail=0.2, seed=SEED).accuracy


def q_fit_noisy_keep_all(spark, sf):
    """C4: the same accuracies from logistic regressions, nothing trimmed."""
    return clf_runs.block_ensemble(noisy_rows(spark, sf), None, "LR", tail=0.2, trim=False, seed=SEED).accuracy


def q_fit_noisy_votes(spark, sf):
    """Forests of the train blocks; accuracy of each test block."""
    tr, te = _train_test(noisy_rows(spark, sf))
    return clf_runs.block_ensemble(tr, te, "RF", tail=0.2, seed=SEED, numTrees=5).per_block


def q_fit_noisy_total(spark, sf):
    """SVMs of sub-blocks; the size-weighted accuracy of the test blocks."""
    tr, te = _train_test(noisy_rows(spark, sf))
    tot = clf_runs.block_ensemble(tr, te, "SVM", tail=0.2, seed=SEED).total
    return tot.select(F.round("accuracy", 9).alias("accuracy"), "n_rows", "n_blocks")


# ------------------------------------------------------------ clustering
def q_fit_noisy_purity(spark, sf):
    """K5, K9: local centers of each block, purity of their clusters."""
    v = noisy_points(spark, sf)
    return K.purity(K.assign_local(v, K.local_kmeans(v, N_POINTS)))


def q_fit_center_error(spark, sf):
    """K1, K8: the true centers lie (0.3, 0.4) beside the fitted ones."""
    v = ruled_points(spark, sf)
    step = F.array(F.lit(0.3), F.lit(0.4))
    truth = _truth(v).withColumn("center", F.zip_with("center", step, lambda a, b: a + b))
    centers = K.fit_centers(v, N_POINTS, "kmeans", SEED)[1]
    return K.center_error(truth, centers).select(F.round("distance", 6).alias("distance"))


def _xy(centers: DataFrame, *keys: str) -> DataFrame:
    return centers.select(*keys, *[F.round(F.col("center")[i], 6).alias(c) for i, c in enumerate("xy")])


def q_fit_kmeans(spark, sf):
    """K1."""
    return _xy(K.fit_centers(ruled_points(spark, sf), N_POINTS, "kmeans", SEED)[1])


def q_fit_bisecting(spark, sf):
    """K2."""
    return _xy(K.fit_centers(ruled_points(spark, sf), N_POINTS, "bisectingkmeans", SEED)[1])


def q_fit_local_bisecting(spark, sf):
    """K5: bisecting k-means of each block."""
    return _xy(K.local_bisecting(ruled_points(spark, sf), N_POINTS, list(range(N_BLOCKS)), SEED), "block_id")


def q_fit_oversampled_kmeans(spark, sf):
    """K5: local k-means of each block from an oversampled start."""
    return _xy(K.local_kmeans(ruled_points(spark, sf), N_POINTS, init="oversampled"), "block_id")


def q_fit_two_level(spark, sf):
    """K5-K7: local centers of all blocks, pooled and clustered again."""
    return _xy(K.two_level(ruled_points(spark, sf), N_POINTS, "kmeans", list(range(N_BLOCKS)), seed=SEED)[1])


def _truth(v: DataFrame) -> DataFrame:
    return v.select(F.col("label").alias("center_id"), F.col("features").alias("center")).distinct()


PLAN_RUNS = [("exact-bisectingkmeans", 2, 2), ("exact-bisectingkmeans", 3, 3), ("exact-bisectingkmeans", 0, 5),
             ("blocks-kmeans", 2, 1), ("blocks-kmeans", 3, 2)]
SHUFFLE_RUNS = [("exact-bisectingkmeans", 4, 2), ("exact-bisectingkmeans", 0, 5),
                ("blocks-bisectingkmeans", 4, 1), ("blocks-bisectingkmeans", 0, 5)]


def q_fit_plan_runs(spark, sf):
    """A plan row, a size without one, and size 0 (the whole table);
    the saved models are read back."""
    from pyspark.ml.clustering import BisectingKMeansModel
    v = ruled_points(spark, sf)
    plan = spark.createDataFrame([(2, [0, 3])], "size INT, block_ids ARRAY<INT>")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    ex = clt_runs.exact_with_plan(v, plan, [2, 3, 0], _truth(v), N_POINTS, "bisectingkmeans", 0.9, SEED, model_path=path)
    bl = clt_runs.blocks_with_plan(v, plan, [2, 3], _truth(v), N_POINTS, subs=0.7, tests=1, seed=SEED)
    saved = [(s, len(BisectingKMeansModel.load(f"{path}/size={s}").clusterCenters())) for s in (2, 3, 0)]
    runs = ex.unionByName(bl)
    found = spark.createDataFrame([("exact-bisectingkmeans", s, n) for s, n in saved], "arm STRING, size INT, saved INT")
    return runs.join(F.broadcast(found), ["arm", "size"], "left")


def q_fit_shuffle_runs(spark, sf):
    """Half a block a unit, and size 0 (the whole table)."""
    v = ruled_points(spark, sf)
    ex = clt_runs.exact_shuffled(v, N_BLOCKS, [4, 0], _truth(v), N_POINTS, unit=0.5, algo="bisectingkmeans", seed=SEED)
    bl = clt_runs.blocks_shuffled(v, N_BLOCKS, [4, 0], _truth(v), N_POINTS, subs=0.75, tests=1, unit=0.5,
                                  algo="bisectingkmeans", seed=SEED)
    return ex.unionByName(bl)


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_fit_")}

# ------------------------------------------------------------ SQL twins
_V = f"""WITH v0 AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_linenumber AS n,
             CAST(l_quantity >= 25 AS INTEGER) AS label FROM lineitem),
v AS (SELECT *, CAST({_hash(SEED, 'row_id')} % {N_BLOCKS} AS INTEGER) AS block_id FROM v0)"""
_TEST = f"block_id IN ({', '.join(map(str, PICKED[1]))})"
_MODELS = _V + """,
s AS (SELECT block_id, count(*) AS n FROM v GROUP BY block_id)
SELECT block_id AS model_id, n - CAST(floor(0.9::DOUBLE * n) AS BIGINT) AS n_validate, 1.0::DOUBLE AS accuracy,
       true AS kept FROM s"""
_VOTES = _V + f" SELECT row_id, block_id, label, label AS prediction FROM v WHERE {_TEST}"
_POINTS = "SELECT DISTINCT 10.0::DOUBLE * l_linenumber AS x, 1.0::DOUBLE * l_linenumber * l_linenumber AS y FROM lineitem"


def _runs(rows, saved: bool) -> str:
    vals = ", ".join(f"('{a}', {s}, {n})" for a, s, n in rows)
    col = ", CASE WHEN arm LIKE 'exact%' THEN k END AS saved" if saved else ""
    return (f"WITH runs(arm, size, n_train_blocks) AS (VALUES {vals}), k AS (SELECT CAST(count(DISTINCT l_linenumber) AS INTEGER) AS k "
            f"FROM lineitem) SELECT arm, size, n_train_blocks, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS purity{col} FROM runs, k")


_NOISY = _V + f""",
w AS (SELECT *, CAST({_hash(f'{SEED}:noise', 'row_id')} % 100 < 4 + 6 * block_id AS INTEGER) AS wrong FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY row_id) AS pos, count(*) OVER (PARTITION BY block_id) AS n_b FROM w),
a AS (SELECT block_id AS model_id, count(*) AS n_validate, avg(CAST(1 - wrong AS DOUBLE)) AS accuracy FROM p
      WHERE pos > floor(0.9::DOUBLE * n_b) GROUP BY block_id)"""
SQL = {
    "fit_noisy_models": _NOISY + """,
o AS (SELECT list(accuracy ORDER BY accuracy) AS l FROM a)
SELECT a.*, accuracy BETWEEN l[2] AND l[len(l) - 1] AS kept FROM a, o""",
    "fit_noisy_keep_all": _NOISY + " SELECT *, true AS kept FROM a",
    "fit_noisy_votes": _NOISY + f""" SELECT block_id, count(*) AS n_rows, avg(CAST(1 - wrong AS DOUBLE)) AS accuracy
FROM w WHERE {_TEST} GROUP BY block_id""",
    "fit_noisy_total": _NOISY + f""" SELECT round(avg(CAST(1 - wrong AS DOUBLE)), 9) AS accuracy, count(*) AS n_rows,
count(DISTINCT block_id) AS n_blocks FROM w WHERE {_TEST}""",
    "fit_noisy_purity": _NOISY + """,
c AS (SELECT block_id, n, n + wrong AS label, count(*) AS m FROM w GROUP BY ALL),
t AS (SELECT block_id, n, max(m) AS top, sum(m) AS alls FROM c GROUP BY block_id, n)
SELECT block_id, CAST(sum(alls) AS BIGINT) AS n_rows, sum(top) / sum(alls) AS purity FROM t GROUP BY block_id""",
    "fit_center_error": "SELECT round(0.25::DOUBLE * count(DISTINCT l_linenumber), 6) AS distance FROM lineitem",
    "fit_block_models": _MODELS,
    "fit_keep_all": _MODELS,
    "fit_forest_votes": _VOTES,
    "fit_svm_blocks": _V + f" SELECT block_id, count(*) AS n_rows, 1.0::DOUBLE AS accuracy FROM v WHERE {_TEST} GROUP BY block_id",
    "fit_multi_site": _VOTES,
    "fit_exact_model": _VOTES,
    "fit_single_model": _V + f""" SELECT 0 AS model_id, count(*) AS n_validate, 1.0::DOUBLE AS accuracy FROM v
WHERE {_hash(f'{SEED}:split', 'row_id')} % 10000 >= 9000""",
    "fit_kmeans": _POINTS,
    "fit_bisecting": _POINTS,
    "fit_two_level": _POINTS,
    "fit_local_bisecting": _V + " SELECT DISTINCT block_id, 10.0::DOUBLE * n AS x, 1.0::DOUBLE * n * n AS y FROM v",
    "fit_oversampled_kmeans": _V + " SELECT DISTINCT block_id, 10.0::DOUBLE * n AS x, 1.0::DOUBLE * n * n AS y FROM v",
    "fit_plan_runs": _runs(PLAN_RUNS, True),
    "fit_shuffle_runs": _runs(SHUFFLE_RUNS, False),
}
