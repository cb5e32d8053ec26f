"""Clustering of all blocks together: one chunk or many give the same centers, and
nearest centers agree with brute force."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import block_centers as C
from tessera.operators import blocks as B
from tessera.operators import cluster as K


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 4))
def test_nearest_by_brute_force(seed, k, d):
    """Whole numbers make many ties: the lowest center wins them."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-3, 4, (50, d)).astype(float) + 1e6, rng.integers(-3, 4, (k, d)).astype(float) + 1e6
    want = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
    assert C.nearest(x, c).tolist() == want.tolist()


def _points(spark, n=600, blocks=3, seed=3):
    rnd = random.Random(seed)
    at = [(0.0, 0.0), (9.0, 1.0), (1.0, 8.0), (20.0, 20.0), (-7.0, 3.0)]
    rows = [(i, i % blocks, [v + rnd.gauss(0, 0.2) for v in at[rnd.randrange(5)]]) for i in range(n)]
    rows += [(n + i, 9, [1.0, 1.0]) for i in range(30)]                       # a block of equal points
    return B.materialise(spark.createDataFrame(rows, "row_id LONG, block_id INT, features ARRAY<DOUBLE>"))


def _centers(df):
    return sorted((r.block_id, r.cluster, tuple(round(v, 9) for v in r.center)) for r in df.collect())


@pytest.mark.parametrize("init", ["lowest", "farthest", "oversampled"])
def test_kmeans_by_chunks(spark, init):
    v = _points(spark)
    one, many = (_centers(K.local_kmeans(v, 5, 12, init=init, chunk_rows=c)) for c in (20_000, 70))
    assert one == many and len(one) == 20


def test_oversampled_start(spark):
    """The same start however rows are dealt; near the true centers; equal points give equal centers."""
    v = _points(spark)
    one, many = (_centers(K.init_oversampled(K.deal(v, "row_id", "block_id", c), 5)) for c in (20_000, 70))
    assert one == many and len(one) == 20
    assert [c for b, _, c in one if b == 9] == [(1.0, 1.0)] * 5
    at = np.array([(0.0, 0.0), (9.0, 1.0), (1.0, 8.0), (20.0, 20.0), (-7.0, 3.0)])
    for b in (0, 1, 2):
        mine = np.array([c for x, _, c in one if x == b])
        assert ((at[:, None] - mine) ** 2).sum(-1).min(1).max() < 0.5
    assert K.init_oversampled(v.limit(0), 5).count() == 0


def test_oversampled_start_is_no_worse(spark):
    """Far outliers draw farthest-first, whose centers then miss groups; sums of squares by brute force."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (1500, 2)) + rng.integers(0, 6, (1500, 1)) * [8, 3], rng.normal(0, 200, (4, 2))])
    v = B.materialise(spark.createDataFrame([(i, 0, r) for i, r in enumerate(x.tolist())],
                                            "row_id LONG, block_id INT, features ARRAY<DOUBLE>"))
    cost = {}
    for init in ("farthest", "oversampled"):
        c = np.array([r.center for r in K.local_kmeans(v, 10, 20, init=init).collect()])
        cost[init] = ((x[:, None] - c) ** 2).sum(-1).min(1).sum()
    assert cost["oversampled"] <= 1.05 * cost["farthest"]


def test_far_rows_are_drawn_by_their_squared_distance(spark):
    """Over many seeds a row three times as far is drawn first nine times as often."""
    v = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 0, [3.0]), (3, 0, [0.0])], "row_id LONG, block_id INT, features ARRAY<DOUBLE>")
    blocks = v.crossJoin(spark.range(2000).select(F.col("id").cast("int").alias("b")))
    rows = blocks.select((F.col("b") * 4 + F.col("row_id")).alias("row_id"), F.col("b").alias("block_id"), "features")
    dealt = K.deal(rows, "row_id", "block_id")
    start = rows.filter("row_id % 4 = 0").select("block_id", F.lit(0).alias("cluster"), F.col("features").alias("center"))
    got = C.draw_far(dealt, start, "row_id", 1, 3, 0).select(F.col("center")[0].alias("x")).groupBy("x").count().collect()
    n = {r.x: r["count"] for r in got}
    assert set(n) == {1.0, 3.0} and abs(n[3.0] / 2000 - 0.9) < 0.03


def test_oversampled_passes_do_not_grow_with_k(spark):
    sc, jobs, v = spark.sparkContext, [], _points(spark)
    v.count()
    for k in (3, 30):
        sc.setJobGroup(f"over-{k}", "")
        K.init_oversampled(v, k).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"over-{k}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_kmeans_from_given_centers(spark):
    v = _points(spark)
    start = K.init_lowest(v, 3)
    one, many = (_centers(K.local_kmeans(v, 3, 4, init=start, chunk_rows=c)) for c in (20_000, 70))
    assert one == many


def test_bisecting_by_chunks(spark):
    v = _points(spark)
    one, many = (_centers(K.local_bisecting(v, 5, chunk_rows=c)) for c in (20_000, 70))
    assert one == many
    per = {b: [c for k, _, c in one if k == b] for b in (0, 1, 2, 9)}
    assert [len(per[b]) for b in (0, 1, 2, 9)] == [5, 5, 5, 1]                # equal points stay one cluster
    assert per[9] == [(1.0, 1.0)]


def test_bisecting_jobs_do_not_grow_with_the_blocks(spark):
    sc, jobs = spark.sparkContext, []
    for blocks in (2, 40):
        v = _points(spark, blocks=blocks)
        v.count()
        sc.setJobGroup(f"bisect-{blocks}", "")
        K.local_bisecting(v, 4).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"bisect-{blocks}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_a_step_reads_packed_chunks_as_they_lie(spark):
    """One cached row a chunk; a step moves the state alone."""
    v = _points(spark)
    dealt = K.deal(v, "row_id", "block_id", 70)
    assert dealt.chunks.count() <= dealt.sizes.agg(F.sum("_n")).first()[0] < 30
    plan = C.weights(dealt, K.init_lowest(dealt, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("FlatMapCoGroupsInArrow"):].split("InMemoryTableScan")[0]
    got = sorted((r.row_id, r.block_id) for r in dealt.rows.collect())
    assert got == sorted((r.row_id, r.block_id) for r in v.collect())


def test_null_ids_are_lowest_in_chunks(spark):
    v = spark.createDataFrame([(None, 0, [7.0]), (1, 0, [1.0]), (2, 0, [2.0]), (3, 1, [3.0])], "row_id LONG, block_id INT, features ARRAY<DOUBLE>")
    rows, chunks = (sorted(map(tuple, K.init_lowest(x, 2).collect())) for x in (v, K.deal(v, "row_id", "block_id", 1)))
    assert rows == chunks
