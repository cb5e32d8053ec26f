"""Classification runs: block ensemble (B), multi-site ensemble (C9-C11),
single model (C12) and the exact arm (C13)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import plurality
from tessera.operators import blocks as B
from tessera.operators import ensemble as E


@dataclass
class EnsembleResult:
    models: object          # kept models: a BlockModels table, or a BlockModel list of a user's own learner
    accuracy: DataFrame     # model_id, n_validate, accuracy, kept
    skipped: list           # blocks skipped (single class)
    votes: DataFrame | None  # row_id, block_id, label, prediction (None: no test set, C8)
    per_block: DataFrame | None
    total: DataFrame | None


def block_ensemble(train_rows: DataFrame, test_rows: DataFrame | None, algo: str, tail: float = 0.1,
                   trim: bool = True, holdout: float = 0.9, parallelism: int = 4, seed: int = 0,
                   svm_split: int = 8, label: str = "label", site_id: int = 0,
                   make_estimator=None, **params) -> EnsembleResult:
    """One ensemble: fit per block (C1; SVM on 8 sub-blocks per block, B11),
    hold-out accuracy (B15 + C2), trim (C3/C4), score kept models on the
    test rows (C5), vote (C6) and weigh the block accuracies (C7).  ``params``
    are the learner's settings.  The four learners fit all blocks together;
    ``make_estimator`` is a user's own learner, fit block by block."""
    spark = train_rows.sparkSession
    rows = train_rows
    if algo == "SVM":
        rows = (B.sub_blocks(rows, "row_id", svm_split, seed)
                .drop(B.BLOCK).withColumnRenamed("sub_block_id", B.BLOCK))
    rows = B.holdout_in_block(rows, "row_id", holdout)
    if make_estimator is None:
        models = E.fit_together(rows, algo, E.label_values(train_rows, label), label, seed=seed, **params)
        found, skipped = models.accuracy, []
    else:
        rows = B.materialise(rows)
        ids = sorted(r[0] for r in rows.select(B.BLOCK).distinct().collect())
        models, skipped = E.fit_blocks(
            rows.filter(F.col("role") == "train"), make_estimator, ids, parallelism, label, site_id=site_id,
            validate=rows.filter(F.col("role") == "validate"))
        rows.unpersist()
        found = E.accuracy_table(spark, models)
    # a block whose validate part is empty has no accuracy: it cannot be ranked
    acc = B.materialise(E.trim(found.filter("n_validate > 0"), tail, enabled=trim))
    kept = models.keep(acc.filter("kept")) if make_estimator is None else E.kept_models(models, acc)
    if test_rows is None:
        return EnsembleResult(kept, acc, skipped, None, None, None)
    voted = E.voted(kept, test_rows).select("row_id", B.BLOCK, label, "prediction")
    per, tot = E.weighted_accuracy(voted, label)
    return EnsembleResult(kept, acc, skipped, voted, per, tot)


def multi_site(sites: Sequence[tuple[DataFrame, str]], test_rows: DataFrame, n_train: int, tail: float,
               seed: int = 0, label: str = "label", parallelism: int = 4, **params):
    """Every site has its own source and algorithm and trains its
    own trimmed ensemble on ``n_train`` random blocks; each site votes on the
    common test rows, one vote per site, then the site votes are voted
    again (C11) and weighed (C7).

    All sites score the same rows, so their kept models pass over one scan
    and the site votes are voted in the row: no union and no shuffle of the test
    rows.  Returns (per-row site votes, final votes,
    total)."""
    scored = test_rows
    site_cols = []
    for i, (src, algo) in enumerate(sites):
        n_total = src.select(F.max(B.BLOCK)).first()[0] + 1
        tr_ids, _ = B.train_test_block_ids(n_total, n_train, 0, f"{seed}:{i}")
        res = block_ensemble(B.blocks_by_ids(src, tr_ids), None, algo, tail, seed=seed,
                             label=label, site_id=i, parallelism=parallelism, **params)
        scored = E.voted(res.models, scored, f"site_{i}")
        site_cols.append(f"site_{i}")
    final = scored.withColumn("prediction", plurality(F.array(*[F.col(c) for c in site_cols])))
    site_votes = final.select("row_id", *site_cols)
    final = final.select("row_id", B.BLOCK, label, "prediction")
    _, tot = E.weighted_accuracy(final, label)
    return site_votes, final, tot


def single_model(rows: DataFrame, algo: str, seed: int = 0, label: str = "label", **params):
    """One model on a 90/10 row split of one block (by a hash of the row
    id, so that it is the same at every partitioning); returns (model,
    accuracy frame)."""
    tagged = B.hash_split(rows, "row_id", 0.9, seed)
    train, test = (tagged.filter(F.col("role") == r).drop("role") for r in ("train", "test"))
    n_classes = rows.select(label).distinct().count()
    model = E.estimator_for(algo, label, seed=seed, n_classes=n_classes, **params).fit(E.with_vector(train))
    scored = E.score_models([E.BlockModel(0, 0, model)], test)
    pred = scored.select(F.lit(0).alias("model_id"), label, F.element_at("predictions", 1).alias("prediction"))
    return model, E.block_accuracy(pred, label=label)


def exact(train_rows: DataFrame, test_rows: DataFrame, algo: str, seed: int = 0, label: str = "label", **params):
    """One model on all the training rows, scored on the test rows."""
    n_classes = train_rows.select(label).distinct().count()
    model = E.estimator_for(algo, label, seed=seed, n_classes=n_classes, **params).fit(E.with_vector(train_rows))
    scored = E.score_models([E.BlockModel(0, 0, model)], test_rows)
    return scored.select("row_id", B.BLOCK, label, F.element_at("predictions", 1).alias("prediction"))
