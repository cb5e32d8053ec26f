"""Plan properties that matter at scale: pruned scans, no Python in the
hot path, no per-block window for the hold-out, broadcast-only center
joins, partial aggregation before shuffles."""

import re

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import cluster as K
from tessera.operators import fim
from tessera.sources import baskets, labelled_vectors

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_baskets_scan_is_pruned_and_partial(spark):
    p = _plan(baskets(spark, SF_SMALL))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    cols = sorted(re.sub(r"#\d+L?", "", c) for c in scans)
    assert cols == ["l_orderkey,l_partkey", "p_partkey,p_brand"]
    assert "partial_collect_set" in p


def test_no_python_in_queries(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for name in ["fim_sum", "fim_vote", "fim_recount", "block_holdout", "clf_vote", "clt_purity"]:
        p = _plan(qs[name](spark, SF_SMALL))
        assert "EvalPython" not in p and "InPandas" not in p, name


def test_holdout_has_no_block_window(spark):
    tx = B.assign_blocks(baskets(spark, SF_SMALL), "tid", 4, 1)
    p = _plan(B.holdout_in_block(tx, "tid", 0.9))
    assert "Window [row_number()" not in p


def test_lloyd_assignment_does_not_shuffle_points(spark):
    v = B.assign_blocks(labelled_vectors(spark, SF_SMALL), "row_id", 3, 1)
    c = K.init_lowest(v, 2).checkpoint(eager=True)
    p = _plan(K.assign_local(v, c))
    assert "BroadcastHashJoin" in p
    # the only exchanges are the tiny center table's, never the points'
    assert p.count("Exchange hashpartitioning") <= 1


def test_recount_broadcasts_small_candidates(spark):
    tx = B.assign_blocks(baskets(spark, SF_SMALL), "tid", 4, 1)
    cands = fim.candidates(fim.local_itemsets(tx, 0.05, "own"))
    p = _plan(fim.recount(tx, cands, 100))
    assert "BroadcastHashJoin" in p
    assert F is not None


def test_blocked_text_scan_prunes_blocks(spark, tmp_path):
    from tessera.sources import read_blocked_text, write_blocked_text
    tx = B.assign_blocks(baskets(spark, SF_SMALL), "tid", 4, 1)
    path = str(tmp_path / "text")
    write_blocked_text(tx, path)
    picked = B.blocks_by_ids(read_blocked_text(spark, path), [1, 2])
    p = _plan(picked)
    assert re.search(r"PartitionFilters: \[[^\]]*block_id", p)
    assert picked.count() == tx.filter("block_id in (1, 2)").count()
