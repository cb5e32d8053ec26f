"""Property tests: Spark expressions against plain-Python references on
randomly generated inputs (one DataFrame per batch of examples)."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.exprs import parse_int_line, plurality
from tessera.operators import blocks as B
from tessera.operators import ensemble as E
from tessera.operators import fim
from tessera.sources import baskets

from conftest import SF_SMALL


def _py_plurality(xs):
    c = Counter(xs)
    top = max(c.values())
    return min(v for v, n in c.items() if n == top)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=9), min_size=1, max_size=60))
def test_plurality_matches_python(spark, arrays):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i INT, a ARRAY<INT>")
    got = {r.i: r.p for r in df.select("i", plurality(F.col("a")).alias("p")).collect()}
    assert got == {i: _py_plurality(a) for i, a in enumerate(arrays)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=8), min_size=1, max_size=40))
def test_parse_int_line_matches_python(spark, rows):
    lines = [" ".join(map(str, r)) for r in rows]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i INT, s STRING")
    got = {r.i: list(r.items) for r in df.select("i", parse_int_line("s").alias("items")).collect()}
    assert got == {i: sorted(set(r)) for i, r in enumerate(rows)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30), st.floats(0, 0.5))
def test_trim_bounds(acc, tail):
    b = E.trim_bounds(acc, tail)
    m, t = len(acc), max(1, int(len(acc) * tail))
    if m <= 2 * t:
        assert b is None
    else:
        lo, hi = b
        kept = [a for a in acc if lo <= a <= hi]
        assert len(kept) >= m - 2 * t and lo <= hi


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40), st.integers(0, 40), st.integers(0, 1000))
def test_block_choice_is_a_seeded_permutation(n, k, seed):
    perm = B.shuffled_block_ids(n, seed)
    assert sorted(perm) == list(range(n)) and perm == B.shuffled_block_ids(n, seed)
    assert B.random_block_ids(n, k, seed) == perm[:k]


def test_one_block_recount_equals_exact(spark):
    tx = B.materialise(B.assign_blocks(baskets(spark, SF_SMALL), "tid", 1, 5))
    n = tx.count()
    loc = fim.local_itemsets(tx, 0.02, "average")
    rec = {tuple(r["items"]): r.support for r in fim.recount(tx, fim.candidates(loc), n).collect()}
    exact = {tuple(r["items"]): r.support for r in fim.exact_itemsets(tx, 0.0001).collect()}
    assert rec and all(exact[k] == v for k, v in rec.items())


def test_same_seed_same_answer(spark):
    a = fim.merge_sum(fim.local_itemsets(
        B.assign_blocks(baskets(spark, SF_SMALL), "tid", 4, 9), 0.02, "own"), 1, None)
    b = fim.merge_sum(fim.local_itemsets(
        B.assign_blocks(baskets(spark, SF_SMALL), "tid", 4, 9), 0.02, "own"), 1, None)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
