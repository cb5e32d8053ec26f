"""The bitmap miner against every subset of small baskets and against MLlib's trees."""
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import block_mining as M
from tessera.operators import fim


def _baskets(n=400, blocks=3, items=9, seed=1):
    rnd = random.Random(seed)
    rows = [(i, i % blocks, sorted({int(rnd.betavariate(1, 2) * items) * 7 - 20 for _ in range(rnd.randrange(6))})) for i in range(n)]
    rows += [(n + i, 0, [1, 2]) for i in range(300)]                  # a hot basket
    return rows + [(n + 400, 5, []), (n + 401, 6, None), (n + 402, 7, [3, 3, 1])]


def _brute(rows, least):
    count = Counter()
    for _, b, items in rows:
        for k in range(1, len(set(items or [])) + 1):
            count.update((b, s) for s in combinations(sorted(set(items)), k))
    return {(b, s, n) for (b, s), n in count.items() if n >= least(b)}


def _found(df):
    got = [(r.block_id, tuple(r["items"]), r.support) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("chunk_rows", [20_000, 20])
@pytest.mark.parametrize("base", [1, 4, 15])
def test_every_subset(spark, chunk_rows, base):
    rows = _baskets()
    tx = spark.createDataFrame(rows, "tid LONG, block_id INT, items ARRAY<INT>").repartition(5)
    least = spark.createDataFrame([(b, base + b) for b in range(6)] + [(7, 0)], "block_id INT, threshold BIGINT")
    want = {x for x in _brute(rows, lambda b: max(1, base + b) if b < 7 else 1)}
    assert _found(M.mine_blocks(tx, least, chunk_rows=chunk_rows)) == want


def test_same_as_trees(spark):
    tx = spark.createDataFrame([r for r in _baskets() if r[2]], "tid LONG, block_id INT, items ARRAY<INT>").filter("block_id < 3")
    a, b = (_found(fim.local_itemsets(tx, 0.05, miner=m)) for m in ("bitmaps", "trees"))
    assert a == b and a
    x, y = ({(tuple(r["items"]), r.support, r.frequency) for r in fim.exact_itemsets(tx, 0.03, miner=m).collect()} for m in ("bitmaps", "trees"))
    assert x == y and x


def test_jobs_do_not_grow_with_the_blocks(spark):
    sc, jobs = spark.sparkContext, []
    for blocks in (2, 300):
        tx = spark.createDataFrame(_baskets(900, blocks)[:900], "tid LONG, block_id INT, items ARRAY<INT>")
        least = spark.range(blocks).select(F.col("id").cast("int").alias("block_id"), F.lit(2).alias("threshold"))
        sc.setJobGroup(f"mine-{blocks}", "")
        M.mine_blocks(tx, least).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"mine-{blocks}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
