"""Registered ensemble and clustering queries, with SQL twins where the
result is deterministic.

Input: ``embeddings`` as labelled vectors in 5 md5 blocks (seed 42).
Evaluation operators (C2, C3, C6, C7, C11, K8-K10) run on fixed-rule
predictions: model ``j`` predicts ``int(features[j] > 0)`` for the binary
label ``int(label >= 5)``.  Local k-means (K5, K6) uses the fixed lowest-id
initialisation and a fixed number of steps, so it has a SQL twin too.
Fitted MLlib models (C1, C5, C9, C12, C13, K1, K2, K7, runs) are checked
rows-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import plurality
from tessera.operators import blocks as B
from tessera.operators import cluster as K
from tessera.operators import ensemble as E
from tessera.plans import clf_runs, clt_runs
from tessera.plans.catalog_fim import _hash
from tessera.session import apply_defaults, ensure_checkpoint_dir
from tessera.sources import labelled_vectors, true_centers

# fixed parameters of the registered queries
SEED = 42
N_BLOCKS = 5
HOLDOUT = 0.9
TAIL = 0.2
SITES = [[0, 1, 2], [3, 4]]
K_LOCAL = 3
STEPS = 3
DIGITS = 4


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return B.materialise(B.assign_blocks(labelled_vectors(spark, sf_dir), "row_id", N_BLOCKS, SEED))


def _binary(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("label") >= 5).cast("int"))


def _rule(j) -> F.Column:
    """Fixed-rule model j: ``int(features[j] > 0)`` (j may be a column)."""
    idx = (j + F.lit(1)) if isinstance(j, F.Column) else F.lit(int(j) + 1)
    return (F.element_at("features", idx) > F.lit(0.0)).cast("int")


# ------------------------------------------------------------ classification
def _rule_accuracy(spark, sf):
    v = _binary(vectors(spark, sf))
    val = B.holdout_in_block(v, "row_id", HOLDOUT).filter(F.col("role") == "validate")
    pred = val.select(F.col("block_id").alias("model_id"), "label", _rule(F.col("block_id")).alias("prediction"))
    return E.block_accuracy(pred)


def q_clf_block_accuracy(spark, sf):
    return _rule_accuracy(spark, sf)


def q_clf_trim_models(spark, sf):
    return E.trim(_rule_accuracy(spark, sf), TAIL)


def _rule_vote(spark, sf):
    v = _binary(vectors(spark, sf))
    acc = E.trim(_rule_accuracy(spark, sf), TAIL)
    kept = sorted(r["model_id"] for r in acc.filter("kept").select("model_id").collect())
    scored = v.withColumn("predictions", F.array(*[_rule(j) for j in kept]))
    return E.vote(scored).select("row_id", "block_id", "label", "prediction")


def q_clf_vote(spark, sf):
    return _rule_vote(spark, sf).select("row_id", "label", "prediction")


def q_clf_weighted_accuracy(spark, sf):
    _, tot = E.weighted_accuracy(_rule_vote(spark, sf))
    return tot.select(F.round("accuracy", 9).alias("accuracy"), "n_rows", "n_blocks")


def q_clf_site_vote(spark, sf):
    v = _binary(vectors(spark, sf))
    per_site = [v.select("row_id", F.lit(i).alias("site_id"),
                         plurality(F.array(*[_rule(j) for j in models])).alias("prediction"))
                for i, models in enumerate(SITES)]
    final = E.vote_long(E.union_sites(per_site))
    return final.join(v.select("row_id", "label"), "row_id").select("row_id", "label", "prediction")


def _real_vectors(spark, sf):
    return vectors(spark, sf)


def q_clf_block_models(spark, sf):
    """C1 + C2 + C3: a decision tree per block (10 labels), hold-out
    accuracy and the trimmed flag."""
    res = clf_runs.block_ensemble(_real_vectors(spark, sf), None, "DT", tail=TAIL, seed=SEED)
    return res.accuracy


def q_clf_score_models(spark, sf):
    """C5 + C6 + C7: per-block random forests on 3 train blocks, scored
    in one pass on the 2 test blocks, voted."""
    v = _real_vectors(spark, sf)
    tr, te = B.split_blocks(v, N_BLOCKS, 3, 2, SEED)
    res = clf_runs.block_ensemble(tr, te, "RF", tail=TAIL, seed=SEED)
    return res.votes


def q_clf_svm_blocks(spark, sf):
    """B11 + C1: linear SVMs on 8 sub-blocks of every train block (binary
    label), single-class sub-blocks skipped, voted on the test blocks."""
    v = _binary(_real_vectors(spark, sf))
    tr, te = B.split_blocks(v, N_BLOCKS, 3, 2, SEED)
    res = clf_runs.block_ensemble(tr, te, "SVM", tail=TAIL, seed=SEED)
    return res.per_block


def q_clf_multi_site(spark, sf):
    """Two sites (DT on one blocking of the training blocks, LR on
    another), voted on test blocks that neither site has seen."""
    train, test = B.split_blocks(_real_vectors(spark, sf), N_BLOCKS, 3, 2, SEED)
    drop = [c for c in ("block_id", "role") if c in train.columns]
    sites = [(B.assign_blocks(train.drop(*drop), "row_id", 3, SEED + s), algo) for s, algo in ((1, "DT"), (2, "LR"))]
    _, final, _ = clf_runs.multi_site(sites, test, n_train=3, tail=TAIL, seed=SEED)
    return final


def q_clf_single_model(spark, sf):
    """One tree on a 90/10 row split of the whole table."""
    _, acc = clf_runs.single_model(_real_vectors(spark, sf), "DT", seed=SEED)
    return acc


def q_clf_exact(spark, sf):
    """One tree on the train rows of a 90/10 hash split."""
    v = B.hash_split(_real_vectors(spark, sf), "row_id", HOLDOUT, SEED)
    pred = clf_runs.exact(v.filter("role = 'train'"), v.filter("role = 'test'"), "DT", seed=SEED)
    _, tot = E.weighted_accuracy(pred)
    return tot


# ------------------------------------------------------------ clustering
def _local(spark, sf):
    return K.local_kmeans(vectors(spark, sf), K_LOCAL, STEPS, init="lowest")


def _long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("center").alias("dim", "value")).withColumn(
        "value", F.round("value", DIGITS))


def q_clt_local_kmeans(spark, sf):
    return _long(_local(spark, sf), "block_id", "cluster")


def q_clt_pooled_centers(spark, sf):
    pooled = K.pooled_centers(_local(spark, sf), K_LOCAL).withColumnRenamed("features", "center")
    return _long(pooled, "point_id")


def q_clt_center_error(spark, sf):
    v = vectors(spark, sf)
    pred = K.pooled_centers(_local(spark, sf), K_LOCAL).withColumnRenamed("features", "center")
    return K.center_error(true_centers(v), pred).select(F.round("distance", DIGITS).alias("distance"))


def _purity(spark, sf):
    v = vectors(spark, sf)
    pooled = (K.pooled_centers(_local(spark, sf), K_LOCAL)
              .select(F.col("point_id").alias("center_id"), F.col("features").alias("center")))
    return K.purity(K.assign_nearest(v, pooled))


def q_clt_purity(spark, sf):
    return _purity(spark, sf)


def q_clt_mean_purity(spark, sf):
    return K.mean_purity(_purity(spark, sf)).select(F.round("mean_purity", 12).alias("mean_purity"), "n_blocks")


def q_clt_two_level(spark, sf):
    _, centers, _ = K.two_level(vectors(spark, sf), K_LOCAL, "kmeans", list(range(N_BLOCKS)), STEPS, SEED)
    return centers


def q_clt_local_bisecting(spark, sf):
    return K.local_bisecting(vectors(spark, sf), K_LOCAL, list(range(N_BLOCKS)), SEED)


def q_clt_kmeans_exact(spark, sf):
    return K.fit_centers(vectors(spark, sf), 10, "kmeans", SEED)[1]


def q_clt_bisecting_exact(spark, sf):
    return K.fit_centers(vectors(spark, sf), 10, "bisectingkmeans", SEED)[1]


def q_clt_plan_runs(spark, sf):
    """K3 + K11: exact and block arms over a plan table."""
    v = vectors(spark, sf)
    tc = true_centers(v)
    plan = spark.createDataFrame([(2, [0, 3]), (3, [1, 2, 4])], "size INT, block_ids ARRAY<INT>")
    import uuid
    models = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"     # S8
    ex = clt_runs.exact_with_plan(v, plan, [2, 3, 1], tc, 10, "kmeans", HOLDOUT, SEED, model_path=models)
    bl = clt_runs.blocks_with_plan(v, plan, [2, 3], tc, 10, subs=0.7, tests=1, algo="kmeans",
                                   steps=STEPS, seed=SEED)
    return ex.unionByName(bl)


def q_clt_shuffle_runs(spark, sf):
    """K4 + K12: exact and block arms over shuffled blocks x unit."""
    v = vectors(spark, sf)
    tc = true_centers(v)
    ex = clt_runs.exact_shuffled(v, N_BLOCKS, [2, 4], tc, 10, unit=1.0, algo="bisectingkmeans", seed=SEED)
    bl = clt_runs.blocks_shuffled(v, N_BLOCKS, [2, 4], tc, 10, subs=0.75, tests=1, unit=1.0,
                                  algo="bisectingkmeans", seed=SEED)
    return ex.unionByName(bl)


QUERIES = {
    "clf_block_accuracy": q_clf_block_accuracy,
    "clf_trim_models": q_clf_trim_models,
    "clf_vote": q_clf_vote,
    "clf_weighted_accuracy": q_clf_weighted_accuracy,
    "clf_site_vote": q_clf_site_vote,
    "clf_block_models": q_clf_block_models,
    "clf_score_models": q_clf_score_models,
    "clf_svm_blocks": q_clf_svm_blocks,
    "clf_multi_site": q_clf_multi_site,
    "clf_single_model": q_clf_single_model,
    "clf_exact": q_clf_exact,
    "clt_local_kmeans": q_clt_local_kmeans,
    "clt_pooled_centers": q_clt_pooled_centers,
    "clt_center_error": q_clt_center_error,
    "clt_purity": q_clt_purity,
    "clt_mean_purity": q_clt_mean_purity,
    "clt_two_level": q_clt_two_level,
    "clt_local_bisecting": q_clt_local_bisecting,
    "clt_kmeans_exact": q_clt_kmeans_exact,
    "clt_bisecting_exact": q_clt_bisecting_exact,
    "clt_plan_runs": q_clt_plan_runs,
    "clt_shuffle_runs": q_clt_shuffle_runs,
}


# ------------------------------------------------------------ SQL twins
VEC = f"""
v AS (SELECT vec_id AS row_id, label, embedding AS f,
             CAST({_hash(SEED, 'vec_id')} % {N_BLOCKS} AS INTEGER) AS block_id FROM embeddings)"""

ACC = VEC + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY row_id) AS pos,
             count(*) OVER (PARTITION BY block_id) AS n FROM v),
val AS (SELECT * FROM r WHERE pos > CAST(floor({HOLDOUT}::DOUBLE * n) AS BIGINT)),
acc AS (SELECT block_id AS model_id, count(*) AS n_validate,
               avg(CAST(CAST(f[block_id + 1] > 0 AS INTEGER) = CAST(label >= 5 AS INTEGER) AS DOUBLE)) AS accuracy
        FROM val GROUP BY block_id),
srt AS (SELECT list_sort(list(accuracy)) AS a, count(*) AS m FROM acc),
bnd AS (SELECT a, m, greatest(1, CAST(floor(m * {TAIL}::DOUBLE) AS BIGINT)) AS t FROM srt),
trimmed AS (SELECT model_id, n_validate, accuracy,
                   CASE WHEN m <= 2 * t THEN true ELSE accuracy >= a[t + 1] AND accuracy <= a[m - t] END AS kept
            FROM acc, bnd)"""

VOTE = ACC + """,
p AS (SELECT v.row_id, CAST(v.f[k.model_id + 1] > 0 AS INTEGER) AS pred
      FROM v, (SELECT model_id FROM trimmed WHERE kept) k),
pc AS (SELECT row_id, pred, count(*) AS c FROM p GROUP BY row_id, pred),
pw AS (SELECT row_id, pred, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, pred) AS rk FROM pc),
voted AS (SELECT v.row_id, v.block_id, CAST(v.label >= 5 AS INTEGER) AS label, pw.pred AS prediction
          FROM v JOIN pw ON v.row_id = pw.row_id AND pw.rk = 1)"""


def _site_sql() -> str:
    rows = ", ".join(f"({i}, {m})" for i, ms in enumerate(SITES) for m in ms)
    return VEC + f""",
sites(site_id, model_id) AS (VALUES {rows}),
sp AS (SELECT v.row_id, s.site_id, CAST(v.f[s.model_id + 1] > 0 AS INTEGER) AS pred FROM v, sites s),
sc AS (SELECT row_id, site_id, pred, count(*) AS c FROM sp GROUP BY row_id, site_id, pred),
sv AS (SELECT row_id, site_id, pred FROM
       (SELECT *, row_number() OVER (PARTITION BY row_id, site_id ORDER BY c DESC, pred) AS rk FROM sc) WHERE rk = 1),
fc AS (SELECT row_id, pred, count(*) AS c FROM sv GROUP BY row_id, pred),
fv AS (SELECT row_id, pred FROM
       (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, pred) AS rk FROM fc) WHERE rk = 1)
SELECT v.row_id, CAST(v.label >= 5 AS INTEGER) AS label, fv.pred AS prediction FROM v JOIN fv USING (row_id)"""


def _lloyd_sql() -> str:
    parts = [VEC + f""",
ve AS (SELECT row_id, block_id, label, generate_subscripts(f, 1) - 1 AS d, unnest(f)::DOUBLE AS x FROM v),
ini AS (SELECT row_id, block_id, CAST(rn - 1 AS INTEGER) AS cluster FROM
        (SELECT row_id, block_id, row_number() OVER (PARTITION BY block_id ORDER BY row_id) AS rn FROM v)
        WHERE rn <= {K_LOCAL}),
c0 AS (SELECT i.block_id, i.cluster, e.d, e.x FROM ini i JOIN ve e USING (row_id))"""]
    for s in range(1, STEPS + 1):
        parts.append(f""",
dist{s} AS (SELECT p.row_id, p.block_id, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS dd
           FROM ve p JOIN c{s - 1} c ON p.block_id = c.block_id AND p.d = c.d GROUP BY p.row_id, p.block_id, c.cluster),
asg{s} AS (SELECT row_id, block_id, cluster FROM
           (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dd, cluster) AS rk FROM dist{s}) WHERE rk = 1),
m{s} AS (SELECT a.block_id, a.cluster, p.d, avg(p.x) AS x FROM asg{s} a JOIN ve p USING (row_id)
        GROUP BY a.block_id, a.cluster, p.d),
c{s} AS (SELECT o.block_id, o.cluster, o.d, coalesce(m.x, o.x) AS x
        FROM c{s - 1} o LEFT JOIN m{s} m USING (block_id, cluster, d))""")
    parts.append(f""",
fin AS (SELECT * FROM c{STEPS}),
pool AS (SELECT block_id * {K_LOCAL} + cluster AS point_id, d, x FROM fin)""")
    return "".join(parts)


LLOYD = _lloyd_sql()

PURITY = LLOYD + """,
pd AS (SELECT p.row_id, c.point_id, sum((p.x - c.x) * (p.x - c.x)) AS dd FROM ve p JOIN pool c USING (d)
       GROUP BY p.row_id, c.point_id),
pa AS (SELECT row_id, point_id AS cluster FROM
       (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dd, point_id) AS rk FROM pd) WHERE rk = 1),
lab AS (SELECT v.block_id, pa.cluster, v.label, count(*) AS n FROM v JOIN pa USING (row_id)
        GROUP BY v.block_id, pa.cluster, v.label),
pcl AS (SELECT block_id, cluster, max(n) AS top, sum(n) AS alln FROM lab GROUP BY block_id, cluster),
pur AS (SELECT block_id, CAST(sum(alln) AS BIGINT) AS n_rows,
               CAST(sum(top) AS DOUBLE) / CAST(sum(alln) AS DOUBLE) AS purity
        FROM pcl GROUP BY block_id)"""

# ``round(x, 4) + 0.0``: rounding a tiny negative value gives IEEE -0.0 in
# DuckDB and 0.0 in Spark (decimal rounding); adding 0.0 turns -0.0 into 0.0
# and changes no other value.
SQL = {
    "clf_block_accuracy": "WITH " + ACC.strip() + "\nSELECT model_id, n_validate, accuracy FROM acc",
    "clf_trim_models": "WITH " + ACC.strip() + "\nSELECT model_id, n_validate, accuracy, kept FROM trimmed",
    "clf_vote": "WITH " + VOTE.strip() + "\nSELECT row_id, label, prediction FROM voted",
    "clf_weighted_accuracy": "WITH " + VOTE.strip() + """,
per AS (SELECT block_id, count(*) AS n_rows, avg(CAST(prediction = label AS DOUBLE)) AS accuracy
        FROM voted GROUP BY block_id)
SELECT round(sum(accuracy * n_rows) / sum(n_rows), 9) AS accuracy, CAST(sum(n_rows) AS BIGINT) AS n_rows,
       count(*) AS n_blocks FROM per""",
    "clf_site_vote": "WITH " + _site_sql().strip(),
    "clt_local_kmeans": "WITH " + LLOYD.strip() + f"""
SELECT block_id, cluster, CAST(d AS INTEGER) AS dim, round(x, {DIGITS}) + 0.0 AS value FROM fin""",
    "clt_pooled_centers": "WITH " + LLOYD.strip() + f"""
SELECT point_id, CAST(d AS INTEGER) AS dim, round(x, {DIGITS}) + 0.0 AS value FROM pool""",
    "clt_center_error": "WITH " + LLOYD.strip() + f""",
tc AS (SELECT label AS center_id, d, avg(x) AS x FROM ve GROUP BY label, d),
dd AS (SELECT t.center_id, p.point_id, sum((t.x - p.x) * (t.x - p.x)) AS dist
       FROM tc t JOIN pool p USING (d) GROUP BY t.center_id, p.point_id)
SELECT round(sum(m), {DIGITS}) AS distance FROM (SELECT center_id, min(dist) AS m FROM dd GROUP BY center_id)""",
    "clt_purity": "WITH " + PURITY.strip() + "\nSELECT block_id, n_rows, purity FROM pur",
    "clt_mean_purity": "WITH " + PURITY.strip() + "\nSELECT round(avg(purity), 12) AS mean_purity, "
                                                  "count(*) AS n_blocks FROM pur",
}
