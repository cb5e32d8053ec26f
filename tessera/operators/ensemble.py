"""Classification ensemble over blocks.

Rows are labelled vectors ``row_id, block_id, label, features ARRAY<DOUBLE>``.

* C1 ``fit_together``: the trees, forests, logistic regressions and SVMs of
  all blocks advance in the same jobs (``block_trees``, ``block_linear``); the
  models are a table.  ``fit_blocks`` is for a user's own MLlib estimator: one
  fit per block, each a distributed job over that block's rows, submitted from a
  bounded thread pool.  Models are fit once and kept (never re-trained by later
  actions).
* C2 ``block_accuracy``: hold-out accuracy from a prediction table;
  ``fit_blocks(validate=...)`` scores each block's model on its own
  validate rows inside the block's pool job.
* C3 ``trim``: tail trimming by value on the sorted accuracies.
* C5 ``score_models``: chained ``transform`` with one prediction column per
  model: one scan of the test rows, no cross product, no shuffle.
  ``vote_counts`` (model tables): one pass over the test rows a part of the
  models of bounded bytes, adding up the votes of each class.
* C6/C11 ``vote``: in-row plurality (tie -> smallest label).
* C7 ``weighted_accuracy``: per-block accuracy and the size-weighted total.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions.exprs import plurality
from tessera.operators.block_linear import LinearSettings, Planes, fit_planes
from tessera.operators.block_trees import Forests, TreeSettings, fit_forests
from tessera.operators.blocks import BLOCK, hold, materialise, release
from tessera.operators.lockstep import matrix

ALGOS = ("RF", "DT", "LR", "SVM")


def estimator_for(algo: str, label_col: str = "label", features_col: str = "vec",
                  seed: int = 0, n_classes: int = 2, **params):
    """MLlib estimator by name (RF, DT, LR, SVM).

    ``LinearSVC`` is binary only; with more classes it is wrapped in
    ``OneVsRest``.
    """
    from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                           OneVsRest, RandomForestClassifier)
    common = dict(labelCol=label_col, featuresCol=features_col)
    if algo == "RF":
        return RandomForestClassifier(numTrees=params.get("numTrees", 40), maxDepth=params.get("maxDepth", 20),
                                      seed=seed, **common)
    if algo == "DT":
        return DecisionTreeClassifier(maxDepth=params.get("maxDepth", 20), seed=seed, **common)
    if algo == "LR":
        return LogisticRegression(maxIter=params.get("maxIter", 50), regParam=params.get("regParam", 0.0),
                                  **common)
    if algo == "SVM":
        svc = LinearSVC(maxIter=params.get("maxIter", 50), regParam=params.get("regParam", 0.0), **common)
        return svc if n_classes <= 2 else OneVsRest(classifier=svc, **common)
    raise ValueError(f"unknown algorithm {algo!r}; one of {ALGOS}")


def with_vector(df: DataFrame, features: str = "features", out: str = "vec") -> DataFrame:
    """Array column -> MLlib vector, only at the MLlib border."""
    return df.withColumn(out, array_to_vector(F.col(features)))


class ConstantModel:
    """Predicts one label: the model of a block that holds no other."""

    def __init__(self, label: float, prediction: str = "prediction"):
        self.label, self.prediction = float(label), prediction

    def copy(self) -> ConstantModel:
        return ConstantModel(self.label, self.prediction)

    def setPredictionCol(self, name: str) -> ConstantModel:  # noqa: N802 - MLlib's name
        self.prediction = name
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, F.lit(self.label))


@dataclass
class BlockModel:
    model_id: int
    block_id: int
    model: object
    site_id: int = 0
    n_validate: int | None = None
    accuracy: float | None = None


def fit_blocks(train: DataFrame, make_estimator: Callable[[], object], block_ids: Sequence[int],
               parallelism: int = 4, label_col: str = "label", needs_two_classes: bool = False,
               site_id: int = 0, col: str = BLOCK,
               validate: DataFrame | None = None,
               pool: str | None = None) -> tuple[list[BlockModel], list[int]]:
    """C1 (+ C2): fit one model per block of ``train`` (rows already
    restricted to the training part).  Returns (models, skipped block ids).

    With ``validate`` rows, the same pool job then scores the block's own
    validate rows and keeps ``n_validate`` and ``accuracy`` on the model:
    one small job per block, never a plan with one branch per model.
    With ``needs_two_classes`` (LR/SVM) a block of a single label gets a
    constant model; only blocks without rows are skipped.  The class census is
    one aggregate over all blocks.
    ``pool`` names a scheduler pool for the fit jobs (with
    ``spark.scheduler.mode=FAIR`` the block jobs share the cluster fairly).
    """
    train, own_train = hold(with_vector(train))
    own_val = False
    if validate is not None:
        validate, own_val = hold(validate)
    skipped: list[int] = []
    ids = [int(b) for b in block_ids]
    if needs_two_classes:
        census = {r[col]: r for r in
                  train.filter(F.col(col).isin(ids)).groupBy(col)
                  .agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).collect()}  # one row a block
        skipped = [b for b in ids if b not in census or census[b]["lo"] is None]
        ids = [b for b in ids if b not in skipped]
        constant = {b: ConstantModel(census[b]["lo"]) for b in ids if census[b]["lo"] == census[b]["hi"]}
    else:
        constant = {}

    def _fit(b):
        if pool:
            train.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        model = constant.get(b) or make_estimator().fit(train.filter(F.col(col) == F.lit(b)))
        bm = BlockModel(b, b, model, site_id)
        if validate is not None:
            mine = validate.filter(F.col(col) == F.lit(b))
            hit = (F.element_at("predictions", 1) == F.col(label_col)).cast("double")
            r = score_models([bm], mine).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("a")).first()
            bm.n_validate, bm.accuracy = int(r["n"]), r["a"]
        return bm

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as workers:
        models = list(workers.map(_fit, ids))
    release(train, own_train)     # models are fit and scored: rows no longer needed
    if validate is not None:
        release(validate, own_val)
    return models, skipped


# ------------------------------------------------------- all blocks together
#: bytes of models that one pass over the test rows takes along
MODEL_BYTES = 64 << 20


@dataclass
class BlockModels:
    """The models of all blocks as a table, with the labels they tell apart."""

    fit: Forests | Planes
    labels: list

    @property
    def accuracy(self) -> DataFrame:
        return self.fit.accuracy

    def keep(self, kept: DataFrame) -> BlockModels:
        """The models listed in ``kept`` (``model_id``)."""
        return BlockModels(self.fit.keep(kept), self.labels)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """The kept models, their accuracies, settings and labels below ``path``."""
        fit = self.fit
        table = fit.nodes if isinstance(fit, Forests) else fit.theta
        table.write.mode(mode).parquet(f"{path}/models")
        fit.accuracy.write.mode(mode).parquet(f"{path}/accuracy")
        about = {"kind": type(fit).__name__, "settings": asdict(fit.settings), "n_classes": fit.n_classes, "col": fit.col,
                 "labels": self.labels, "n_features": getattr(fit, "n_features", None)}
        table.sparkSession.createDataFrame([(json.dumps(about),)], "value STRING").coalesce(1).write.mode(mode).text(f"{path}/about")

    @staticmethod
    def load(spark, path: str) -> BlockModels:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        table, accuracy = spark.read.parquet(f"{path}/models"), spark.read.parquet(f"{path}/accuracy")
        k, col = about["n_classes"], about["col"]
        if about["kind"] == "Forests":
            return BlockModels(Forests(table, accuracy, TreeSettings(**about["settings"]), k, col), about["labels"])
        return BlockModels(Planes(table, accuracy, LinearSettings(**about["settings"]), k, about["n_features"], col), about["labels"])

    def __iter__(self):
        """One ``BlockModel`` a block; its ``model`` is the block's row of ``summary``."""
        for r in self.fit.summary().orderBy("model_id").collect():
            yield BlockModel(r["model_id"], r["model_id"], r)


def label_values(rows: DataFrame, label: str = "label") -> list:
    """The labels in ascending order (a list as long as the classes)."""
    return sorted(r[0] for r in rows.filter(F.col(label).isNotNull()).select(label).distinct().collect())


def fit_together(rows: DataFrame, algo: str, labels: list, label: str = "label", order: str = "row_id",
                 seed: int = 0, col: str = BLOCK, features: str = "features", **params) -> BlockModels:
    """C1 + C2 for all blocks in jobs whose number does not depend on the
    blocks.  ``rows`` have a ``role``: ``train`` rows are learnt, ``validate`` rows
    measure their block's model.  Rows without a label are left out."""
    y = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1).cast("int")
    rows = rows.filter(F.col(label).isNotNull()).select(F.col(col).cast("int").alias(col), order, "role", y.alias("y"),
                                                        F.col(features).alias("features"))
    one = rows.filter("features is not null").select(F.size("features")).first()      # all rows have as many
    d = one[0] if one else 0
    k = max(2, len(labels))
    if algo in ("DT", "RF"):
        return BlockModels(fit_forests(rows, TreeSettings.of(algo, d, seed, **params), d, k, order, col), labels)
    if algo in ("LR", "SVM"):
        return BlockModels(fit_planes(rows, LinearSettings.of(algo, **params), d, k, order, col), labels)
    raise ValueError(f"unknown algorithm {algo!r}; one of {ALGOS}")


def _model_parts(models: BlockModels, limit: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of model ids whose rows take up to ``limit`` bytes."""
    sizes = models.fit.table().groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).orderBy("model_id").collect()  # a row a model
    parts, used = [], 0
    for r in sizes:
        size = r["n"] * models.fit.row_bytes
        if parts and used + size <= limit:
            parts[-1], used = (parts[-1][0], r["model_id"]), used + size
        else:
            parts.append((r["model_id"], r["model_id"]))
            used = size
    return parts


def vote_counts(models: BlockModels, rows: DataFrame, out: str = "votes", features: str = "features",
                limit: int = MODEL_BYTES) -> DataFrame:
    """C5 for model tables: the number of models that predict each label, as an
    array in the order of ``models.labels``.  A part of the models (up to
    ``limit`` bytes) goes to the tasks at a time and adds its votes; no shuffle."""
    k = max(2, len(models.labels))
    df = rows.withColumn(out, F.array_repeat(F.lit(0), k))
    schema = df.schema
    schema[out].dataType = ArrayType(IntegerType())
    at, vec = df.columns.index(out), df.columns.index(features)
    for lo, hi in _model_parts(models, limit):
        score = models.fit.scorer(models.fit.table().filter(F.col("model_id").between(lo, hi)).toArrow())

        def run(batches, score=score):
            for batch in batches:
                n = len(batch)
                cols = batch.columns
                if n:
                    pred = score(matrix(pa.chunked_array([cols[vec]])))
                    cell = np.arange(n)[:, None] * k + pred
                    votes = np.bincount(cell.ravel(), minlength=n * k) + matrix(pa.chunked_array([cols[at]])).ravel().astype(np.int64)
                    cols[at] = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(votes, pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        df = df.mapInArrow(run, schema)
    return df


def voted(models: BlockModels | Sequence[BlockModel], rows: DataFrame, out: str = "prediction") -> DataFrame:
    """C5 + C6: the label that most of the models predict (ties: the smallest)."""
    if not isinstance(models, BlockModels):
        return vote(score_models(models, rows, out="_predictions"), "_predictions", out).drop("_predictions")
    if not models.labels:
        return rows.withColumn(out, F.lit(None).cast("int"))
    values = F.array(*[F.lit(v) for v in models.labels])
    top = F.array_position("_votes", F.array_max("_votes")).cast("int")
    return vote_counts(models, rows, "_votes").withColumn(out, F.element_at(values, top)).drop("_votes")


def score_models(models: Sequence[BlockModel], rows: DataFrame, out: str = "predictions",
                 features: str = "features", group: int = 32) -> DataFrame:
    """Every model scores every row in one pass.

    Each model writes its own prediction column; probability and raw
    columns are dropped right away.  After every ``group`` models their
    predictions are folded into one array column, so a row never carries
    more than ``group`` prediction columns however large the ensemble.
    Result: the input columns plus ``predictions ARRAY<INT>`` (model order).
    """
    df = with_vector(rows, features, "vec")
    folded: list[str] = []
    pending: list[str] = []
    for i, bm in enumerate(models):
        m = bm.model.copy()
        pc = f"_p{i}"
        for setter, val in (("setPredictionCol", pc), ("setFeaturesCol", "vec"),
                            ("setRawPredictionCol", f"_r{i}"), ("setProbabilityCol", f"_q{i}")):
            if hasattr(m, setter):
                getattr(m, setter)(val)
        df = m.transform(df)
        df = df.drop(*[c for c in (f"_r{i}", f"_q{i}") if c in df.columns])
        pending.append(pc)
        if len(pending) == group or i == len(models) - 1:
            g = f"_g{len(folded)}"
            df = df.withColumn(g, F.array(*[F.col(n).cast("int") for n in pending])).drop(*pending)
            folded.append(g)
            pending = []
    if not folded:
        arr = F.array().cast("array<int>")
    elif len(folded) == 1:
        arr = F.col(folded[0])
    else:
        arr = F.concat(*[F.col(g) for g in folded])
    return df.withColumn(out, arr).drop("vec", *folded)


def block_accuracy(pred: DataFrame, model_col: str = "model_id", label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """``model_id, n_validate, accuracy`` from a long prediction table."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return pred.groupBy(model_col).agg(F.count(F.lit(1)).alias("n_validate"), F.avg(hit).alias("accuracy"))


def accuracy_table(spark, models: Sequence[BlockModel]) -> DataFrame:
    """C2 table ``model_id, n_validate, accuracy`` from models scored by
    ``fit_blocks(validate=...)`` (one row per model)."""
    rows = [(m.model_id, m.n_validate, m.accuracy) for m in models]
    return spark.createDataFrame(rows, "model_id INT, n_validate BIGINT, accuracy DOUBLE")


def trim_bounds(accuracies: Sequence[float], tail: float) -> tuple[float, float] | None:
    """C3 bounds: sort, ``t = max(1, int(m * tail))``, keep values in
    ``[acc[t], acc[m-t-1]]``; ``None`` (keep all) when ``m <= 2t``."""
    acc = sorted(accuracies)
    m = len(acc)
    t = max(1, int(m * tail))
    if m <= 2 * t:
        return None
    return acc[t], acc[m - t - 1]


def trim(acc: DataFrame, tail: float, enabled: bool = True, value: str = "accuracy") -> DataFrame:
    """C3 (and C4 with ``enabled=False``): add ``kept`` to the accuracy table.

    The sorted accuracy list has one entry per model (bounded by the model
    count, not the data); its two bounds come back as literals.
    """
    if not enabled:
        return acc.withColumn("kept", F.lit(True))
    row = acc.agg(F.array_sort(F.collect_list(value)).alias("a")).first()
    bounds = trim_bounds(row["a"] or [], tail)
    if bounds is None:
        return acc.withColumn("kept", F.lit(True))
    lo, hi = bounds
    return acc.withColumn("kept", (F.col(value) >= F.lit(lo)) & (F.col(value) <= F.lit(hi)))


def vote(pred: DataFrame, predictions: str = "predictions", out: str = "prediction") -> DataFrame:
    """Plurality of the model predictions in each row."""
    return pred.withColumn(out, plurality(F.col(predictions)))


def vote_long(pred: DataFrame, key: str = "row_id", prediction: str = "prediction",
              out: str = "prediction") -> DataFrame:
    """C11 on a long table (one row per voter): one list per key, bounded
    by the number of voters, then the in-row plurality."""
    return (pred.groupBy(key).agg(F.collect_list(prediction).alias("_v"))
            .select(key, plurality(F.col("_v")).alias(out)))


def weighted_accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      col: str = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(per-block ``block_id, n_rows, accuracy``, one-row total
    ``sum(acc * n) / sum(n)``)."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    per = pred.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(hit).alias("accuracy"))
    tot = per.agg((F.sum(F.col("accuracy") * F.col("n_rows")) / F.sum("n_rows")).alias("accuracy"),
                  F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_blocks"))
    return per, tot


def kept_models(models: Sequence[BlockModel], acc: DataFrame) -> list[BlockModel]:
    """Models whose ``kept`` flag is set (the flag table has one row per model)."""
    keep = {r["model_id"] for r in acc.filter("kept").select("model_id").collect()}
    return [m for m in models if m.model_id in keep]


def union_sites(preds: Sequence[DataFrame]) -> DataFrame:
    """Bag union of the per-site prediction tables."""
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out
