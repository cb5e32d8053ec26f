"""A key holding a third of all rows: operators stay exact and a hot block
is spread over several tasks when written."""

import os

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import fim


def _skewed(spark, n=9000):
    # rows 0..2999 share key 7 (one hot block); items cycle so baskets differ
    df = spark.range(n).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") < n // 3, F.lit(7)).otherwise(F.col("id")).alias("key"),
        F.array_sort(F.array_distinct(F.array((F.col("id") % 5).cast("int"),
                                              (F.col("id") % 7).cast("int") + 5))).alias("items"))
    return B.materialise(B.assign_blocks(df, "key", 4, 1))


def test_hot_block_holdout_exact(spark):
    df = _skewed(spark)
    inv = {r.block_id: r.n_rows for r in B.block_inventory(df).collect()}
    hot = max(inv, key=inv.get)
    assert inv[hot] >= 3000
    out = B.holdout_in_block(df, "rid", 0.9)
    got = {r.block_id: r.t for r in out.groupBy("block_id")
           .agg(F.sum((F.col("role") == "train").cast("int")).alias("t")).collect()}
    assert got == {b: int(0.9 * n) for b, n in inv.items()}


def test_hot_block_mining_matches_exact(spark):
    df = _skewed(spark)
    loc = fim.local_itemsets(df, 0.05, "own")
    for b in [r.block_id for r in df.select("block_id").distinct().collect()]:
        rows = df.filter(F.col("block_id") == b)
        n = rows.count()
        mine = {tuple(r["items"]): r.support for r in loc.filter(F.col("block_id") == b).collect()}
        ref = {tuple(r["items"]): r.support for r in fim.exact_itemsets(rows, 0.0001).collect()
               if r.support >= max(1, int(0.05 * n))}
        assert mine == ref


def test_hot_block_written_by_several_tasks(spark, tmp_path):
    df = _skewed(spark)
    inv = {r.block_id: r.n_rows for r in B.block_inventory(df).collect()}
    hot = max(inv, key=inv.get)
    path = str(tmp_path / "t")
    B.write_blocked(df, path, key="rid", tasks_per_block=4)
    files = [f for f in os.listdir(os.path.join(path, f"block_id={hot}")) if f.endswith(".parquet")]
    assert len(files) >= 2
    assert spark.read.parquet(path).count() == 9000


def test_rebalanced_write(spark, tmp_path):
    df = _skewed(spark)
    path = str(tmp_path / "r")
    B.write_blocked(df, path, rebalance=True)
    assert spark.read.parquet(path).count() == 9000
