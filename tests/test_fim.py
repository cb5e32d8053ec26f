"""Itemset operators on the hand-worked case of FIXTURES.md section 3.1
plus properties on the brand baskets."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import fim
from tessera.plans import fim_runs
from tessera.sources import baskets

from conftest import SF_SMALL

TX = [(0, 0, [1, 2]), (1, 0, [1, 2]), (2, 0, [1, 3]), (3, 0, [2, 3]),
      (4, 1, [1, 2]), (5, 1, [1, 2, 3]), (6, 1, [1, 3]), (7, 1, [1, 2])]


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(TX, "tid LONG, block_id INT, items ARRAY<INT>")


def _as_dict(df, *cols):
    return {tuple(r["items"]): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
            for r in df.collect()}


def test_local_itemsets(tx):
    loc = fim.local_itemsets(tx, 0.5, "own")
    got = {(r.block_id, tuple(r["items"])): r.support for r in loc.collect()}
    assert got == {(0, (1,)): 3, (0, (2,)): 3, (0, (3,)): 2, (0, (1, 2)): 2,
                   (1, (1,)): 4, (1, (2,)): 3, (1, (3,)): 2, (1, (1, 2)): 3, (1, (1, 3)): 2}


def test_thresholds(tx):
    own = {r.block_id: r.threshold for r in fim.local_thresholds(tx, 0.5, "own").collect()}
    avg = {r.block_id: r.threshold for r in fim.local_thresholds(tx, 0.5, "average").collect()}
    assert own == {0: 2, 1: 2} and avg == {0: 2, 1: 2}
    low = {r.block_id: r.threshold for r in fim.local_thresholds(tx, 0.01, "own").collect()}
    assert low == {0: 1, 1: 1}        # clamped to >= 1


def test_vote(tx):
    loc = fim.local_itemsets(tx, 0.5, "own")
    assert _as_dict(fim.merge_vote(loc, 2, 0.5), "support") == {(1, 2): 2, (1, 3): 2}
    assert _as_dict(fim.merge_vote(loc, 2, 1.0), "support") == {(1, 2): 2}


def test_sum(tx):
    loc = fim.local_itemsets(tx, 0.5, "own")
    got = _as_dict(fim.merge_sum(loc, 8, None), "support", "frequency")
    assert got == {(1,): (7, 0.875), (2,): (6, 0.75), (3,): (4, 0.5), (1, 2): (5, 0.625), (1, 3): (2, 0.25)}


def test_candidates_and_recount(tx):
    loc = fim.local_itemsets(tx, 0.5, "own")
    cands = fim.candidates(loc)
    assert {tuple(r["items"]) for r in cands.collect()} == {(1, 2), (1, 3)}
    got = _as_dict(fim.recount(tx, cands, 8), "support", "frequency")
    assert got == {(1, 2): (5, 0.625), (1, 3): (3, 0.375)}
    kept = _as_dict(fim.recount(tx, cands, 8, min_support=0.5), "support")
    assert kept == {(1, 2): 5}
    # the shuffle-join path gives the same answer
    assert _as_dict(fim.recount(tx, cands, 8, broadcast_limit=0), "support") == {(1, 2): 5, (1, 3): 3}


def test_exact(tx):
    got = _as_dict(fim.exact_itemsets(tx, 0.5), "support")
    assert got == {(1,): 7, (2,): 6, (3,): 4, (1, 2): 5}


def test_key_and_lines(tx):
    loc = fim.local_itemsets(tx, 0.5, "own")
    lines = {r.value for r in fim.text_lines(fim.merge_vote(loc, 2, 0.5)).collect()}
    assert lines == {"{1,2}: 2", "{1,3}: 2"}
    k = fim.with_key(fim.drop_singletons(fim.merge_sum(loc, 8, None)))
    assert {r.itemset for r in k.collect()} == {"{1,2}", "{1,3}"}


@pytest.fixture(scope="module")
def brand(spark):
    return B.materialise(B.assign_blocks(baskets(spark, SF_SMALL), "tid", 4, 42))


def test_properties_on_baskets(brand):
    n = brand.count()
    exact = _as_dict(fim.exact_itemsets(brand, 0.02), "support")
    summed = _as_dict(fim.merge_sum(fim.local_itemsets(brand, 0.02, "own"), n, None), "support")
    # sum merge is a lower bound of the true support
    allx = _as_dict(fim.exact_itemsets(brand, 0.0001), "support")
    for k, s in summed.items():
        assert s <= allx[k]
    # recount equals exact support on the same rows
    rec = _as_dict(fim.recount(brand, fim.candidates(fim.local_itemsets(brand, 0.02, "average"))), "support")
    for k, s in rec.items():
        assert s == allx.get(k, 0)
    # vote 1.0 is a subset of vote 0.5
    loc = fim.local_itemsets(brand, 0.02, "average")
    v5 = set(_as_dict(fim.merge_vote(loc, 4, 0.5), "support"))
    v10 = set(_as_dict(fim.merge_vote(loc, 4, 1.0), "support"))
    assert v10 <= v5
    assert exact


def test_one_block_sum_equals_exact(spark, brand):
    one = brand.withColumn("block_id", F.lit(0))
    n = one.count()
    s = _as_dict(fim.merge_sum(fim.local_itemsets(one, 0.05, "own"), n, None), "support")
    e = _as_dict(fim.exact_itemsets(one, 0.05), "support")
    # own threshold floor(0.05 n) vs exact ceil(0.05 n): equal unless 0.05 n is fractional
    c_own, c_exact = int(0.05 * n), -(-int(0.05 * n * 1000) // 1000)
    if c_own == c_exact:
        assert s == e
    else:
        assert {k: v for k, v in s.items() if v >= c_exact} == e


def test_arms_run(brand):
    n = brand.count()
    assert fim_runs.sum_arm(brand, 4, 0.02).count() > 0
    assert fim_runs.vote_arm(brand, 4, 0.02, 0.5, 42).count() > 0
    rc = fim_runs.recount_arm(brand, 4, 2, 0.02, 7)
    assert rc.filter(F.col("frequency") < 0.02).count() == 0
    sw = fim_runs.sweep(brand, [1, 2], 0.02)
    assert {r.size for r in sw.select("size").distinct().collect()} <= {1, 2}
    with pytest.raises(ValueError):
        fim_runs.sweep(brand, [], 0.02)
    assert n > 0


def test_batched_mining_equals_one_run(brand):
    one = {(r.block_id, tuple(r["items"])): r.support for r in fim.local_itemsets(brand, 0.02, "own").collect()}
    batched = {(r.block_id, tuple(r["items"])): r.support
               for r in fim.local_itemsets(brand, 0.02, "own", blocks_per_run=3).collect()}
    assert one == batched and one


def test_recount_anchor_variants(brand):
    cands = fim.candidates(fim.local_itemsets(brand, 0.02, "average"))
    a = _as_dict(fim.recount(brand, cands, anchor="rarest"), "support")
    b = _as_dict(fim.recount(brand, cands, anchor="first"), "support")
    c = _as_dict(fim.recount(brand, cands, anchor="rarest", broadcast_limit=0), "support")
    loc = fim.local_itemsets(brand, 0.02, "average")
    d = _as_dict(fim.recount(brand, cands, item_freq=fim.local_item_freq(loc)), "support")
    assert a == b == c == d and a


def test_local_mining_keeps_callers_cache(spark, brand):
    mine = B.materialise(brand.select("block_id", "items"))
    mine.count()
    fim.local_itemsets(mine, 0.02, "own").count()
    assert mine.storageLevel.useMemory or mine.storageLevel.useDisk


def test_bands_split_unlike_thresholds():
    thr = {0: 1, 1: 100, 2: 140, 3: 151, 4: 1}
    assert fim.threshold_bands(thr) == [[0, 4], [1, 2], [3]]


def test_tiny_block_does_not_lower_the_others(spark, monkeypatch):
    rows = [(i, 0 if i < 40 else 1, sorted({1, 2 + i % 3, 5 + i % 7, 12 + i % 11})) for i in range(4040)]
    tx = spark.createDataFrame(rows, "tid LONG, block_id INT, items ARRAY<INT>")
    mined = []
    real = fim.FPGrowth.fit

    def fit(self, df):
        model = real(self, df)
        mined.append(model.freqItemsets.count())
        return model
    monkeypatch.setattr(fim.FPGrowth, "fit", fit)
    kept = fim.local_itemsets(tx, 0.05, "own", miner="trees").count()
    assert len(mined) == 2 and kept <= sum(mined) <= 2 * kept


def test_exact_by_blocks_equals_fp_growth(brand):
    one = {(tuple(r["items"]), r.support) for r in fim.exact_itemsets(brand, 0.02).collect()}
    assert {(tuple(r["items"]), r.support) for r in fim.exact_by_blocks(brand, 0.02).collect()} == one
    assert {(tuple(r["items"]), r.support) for r in fim.exact_by_blocks(brand, 0.02, broadcast_limit=0).collect()} == one


def test_dictionary_is_exact(spark):
    from tessera.sources import item_dictionary, read_table
    d = item_dictionary(spark, "/root/testdata/sf0.001", "p_name").collect()
    want = sorted(r[0] for r in read_table(spark, "/root/testdata/sf0.001", "part").select("p_name").distinct().collect())
    assert [r.name for r in sorted(d, key=lambda r: r["item"])] == want
    assert sorted(r["item"] for r in d) == list(range(1, len(want) + 1))


def test_picks_prune_directories(spark):
    from tessera.plans import catalog_fim as C
    for name in ("blocks_first_n", "blocks_by_ids", "blocks_random_n", "block_train_test", "blocks_fraction"):
        plan = C.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(block_id" in plan or "PartitionFilters: [block_id" in plan, (name, plan)
        assert "InMemoryTableScan" not in plan


def test_block_sizes_count_empty_baskets(spark):
    df = spark.createDataFrame([(0, 0, []), (1, 0, [1, 2]), (2, 1, [3]), (3, 1, [])],
                               "tid LONG, block_id INT, items ARRAY<INT>")
    assert fim.block_sizes(df) == {0: 2, 1: 2}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "tid LONG, block_id INT, items ARRAY<INT>")
    assert fim.exact_itemsets(empty, 0.1).count() == 0
    assert fim.local_itemsets(empty, 0.1).count() == 0
    assert fim.merge_sum(fim.local_itemsets(empty, 0.1), 1, None).count() == 0
    assert fim.recount(empty, empty.select("items"), 1).count() == 0
