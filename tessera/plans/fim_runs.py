"""End-to-end itemset arms (the runs a user launches), built from operators.

* ``sum_arm``     - first n blocks, own thresholds, sum merge, floor   (A)
* ``vote_arm``    - re-block to n, average threshold, vote merge       (F4)
* ``sampled_vote_arm`` - text source, fraction of blocks, vote, lines  (F5)
* ``recount_arm`` - sampled blocks, candidates, exact recount, floor   (F6+F7)
* ``exact_arm``   - MLlib FP-growth on the same rows                   (F1/F2)
* ``sweep``, ``sweep_exact``, ``sweep_vote`` - one result per block count, unioned (F9)
* ``sweep_support``, ``sweep_support_vote`` - one exact or voted result per min-support, mined once (F9)
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import fim
from tessera.operators.block_mining import supports_by_block
from tessera.sources import sinks


def sum_arm(tx: DataFrame, n_first: int, min_support: float, floor: float | None = 0.01,
            num_partitions: int | None = None) -> DataFrame:
    """A: local mining of the first ``n_first`` blocks with each block's own
    threshold, summed over blocks; frequency over the rows of those blocks."""
    rows = B.first_blocks(tx, n_first)
    sizes = fim.block_sizes(rows)
    local = fim.local_itemsets(rows, min_support, "own", num_partitions=num_partitions, sizes=sizes)
    return fim.merge_sum(local, sum(sizes.values()), floor)


def vote_arm(tx: DataFrame, n_blocks: int, min_support: float, vote: float, seed,
             key: str = "tid", num_partitions: int | None = None) -> DataFrame:
    """F4 arm: all rows re-blocked into ``n_blocks`` (B10); every block mined
    with ``floor(N * min_support / n_blocks)``; itemsets of length > 1 voted."""
    rows = B.assign_blocks(tx.drop(B.BLOCK) if B.BLOCK in tx.columns else tx, key, n_blocks, seed)
    local = fim.local_itemsets(rows, min_support, "average", n_blocks=n_blocks,
                               num_partitions=num_partitions)
    return fim.merge_vote(local, n_blocks, vote)


def sampled_vote_arm(tx: DataFrame, n_total: int, fraction: float, min_support: float,
                     vote: float, pick_seed) -> DataFrame:
    """vote merge on ``ceil(n_total * fraction)`` seeded random blocks;
    result as ``"{a,b}: n"`` text lines (S6 form)."""
    k = max(1, B.fraction_block_count(n_total, fraction))
    rows = B.random_blocks(tx, n_total, k, pick_seed)
    local = fim.local_itemsets(rows, min_support, "average", n_blocks=k)
    return fim.text_lines(fim.merge_vote(local, k, vote))


def recount_arm(tx: DataFrame, n_total: int, n_sampled: int, min_support: float, pick_seed,
                broadcast_limit: int = fim.BROADCAST_CANDIDATES) -> DataFrame:
    """F6 + F7: candidates from ``n_sampled`` random blocks (average
    threshold), recounted exactly on the same rows, kept at ``min_support``."""
    rows = B.materialise(B.random_blocks(tx, n_total, n_sampled, pick_seed))
    sizes = fim.block_sizes(rows)
    local = fim.local_itemsets(rows, min_support, "average", n_blocks=n_sampled, sizes=sizes)
    return fim.recount(rows, fim.candidates(local), sum(sizes.values()), min_support, broadcast_limit,
                       item_freq=fim.local_item_freq(local))


def exact_arm(tx: DataFrame, min_support: float, n_first: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """exact FP-growth over the (first n blocks of the) table."""
    rows = B.first_blocks(tx, n_first) if n_first is not None else tx
    return fim.exact_itemsets(rows, min_support, num_partitions)


def sweep(tx: DataFrame, sizes: Sequence[int], min_support: float,
          floor: float | None = 0.01) -> DataFrame:
    """the sum arm for every block count in ``sizes``, with a ``size``
    column.

    With each block's own threshold a block's local itemsets do not depend
    on the other blocks, so the first ``max(sizes)`` blocks are mined once
    and every size is a cheap merge of its ``block_id < size`` part.
    """
    if not sizes:
        raise ValueError("sizes must not be empty")
    rows = B.first_blocks(tx, max(sizes))
    bsz = fim.block_sizes(rows)
    local = fim.local_itemsets(rows, min_support, "own", sizes=bsz)
    parts = []
    for s in sizes:
        n = sum(v for b, v in bsz.items() if b < s)
        parts.append(fim.merge_sum(B.first_blocks(local, s), n, floor).withColumn("size", F.lit(int(s))))
    return reduce(DataFrame.unionByName, parts)


def sweep_exact(tx: DataFrame, sizes: Sequence[int], min_support: float) -> DataFrame:
    """the exact arm on the first n blocks for every n in ``sizes``, from one
    mining: what is frequent in some first blocks is frequent, at the same share,
    in one of them, so the local itemsets hold every answer; their supports by
    block, added up to each size, decide."""
    if not sizes:
        raise ValueError("sizes must not be empty")
    rows = B.first_blocks(tx, max(sizes))
    if not fim.int_items(rows):
        return reduce(DataFrame.unionByName, [exact_arm(tx, min_support, n_first=s).withColumn("size", F.lit(int(s)))
                                              for s in sizes])
    bsz = fim.block_sizes(rows)
    local = fim.local_itemsets(rows, min_support, "own", sizes=bsz)
    upto = [F.sum(F.when(F.col(B.BLOCK) < s, F.col("support"))).alias(f"s{i}") for i, s in enumerate(sizes)]
    counted = B.materialise(supports_by_block(rows, local).groupBy("items").agg(*upto))
    parts = []
    for i, s in enumerate(sizes):
        n = sum(v for b, v in bsz.items() if b < s)
        found = counted.select("items", F.col(f"s{i}").alias("support")).filter(F.col("support") >= max(1, math.ceil(min_support * n)))
        parts.append(fim.with_frequency(found, max(n, 1)).withColumn("size", F.lit(int(s))))
    return reduce(DataFrame.unionByName, parts)


def sweep_vote(tx: DataFrame, sizes: Sequence[int], min_support: float, vote: float, seed) -> DataFrame:
    """the vote arm for every block count in ``sizes`` (each re-blocks all rows)."""
    if not sizes:
        raise ValueError("sizes must not be empty")
    return reduce(DataFrame.unionByName, [vote_arm(tx, s, min_support, vote, seed).withColumn("size", F.lit(int(s)))
                                          for s in sizes])


def sweep_support(tx: DataFrame, supports: Sequence[float]) -> DataFrame:
    """the exact arm for every min-support; mined once, at the least one."""
    if not supports:
        raise ValueError("supports must not be empty")
    n = tx.count()
    found = B.materialise(fim.exact_itemsets(tx, min(supports), n_rows=n))
    return reduce(DataFrame.unionByName, [found.filter(F.col("support") >= math.ceil(s * n))
                                          .withColumn("min_support", F.lit(float(s))) for s in supports])


def sweep_support_vote(tx: DataFrame, supports: Sequence[float], n_blocks: int, vote: float, seed,
                       key: str = "tid") -> DataFrame:
    """the vote arm for every min-support, with a ``min_support`` column.  The
    blocks are mined once, at the least support; a larger one raises the
    blocks' common threshold."""
    if not supports:
        raise ValueError("supports must not be empty")
    rows = B.materialise(B.assign_blocks(tx.drop(B.BLOCK), key, n_blocks, seed))
    sizes = fim.block_sizes(rows)
    local = fim.local_itemsets(rows, min(supports), "average", n_blocks=n_blocks, sizes=sizes)
    rows.unpersist()
    parts = []
    for s in supports:
        least = max(fim.threshold_counts(sizes, s, "average", n_blocks).values(), default=1)
        parts.append(fim.merge_vote(local.filter(F.col("support") >= least), n_blocks, vote).withColumn("min_support", F.lit(float(s))))
    return reduce(DataFrame.unionByName, parts)


def write_result(itemsets: DataFrame, head: str, n_blocks: int, arm: str,
                 csv_path: str | None = None, mode: str = "overwrite") -> int:
    """S4 + S5 + P6: drop 1-itemsets, write ``<head>_<n>Block_<arm>.parquet``
    (and a single-file CSV when ``csv_path`` is given); returns the number
    of itemsets written."""
    kept = fim.drop_singletons(itemsets).persist()
    n = kept.count()
    sinks.write_parquet(kept, f"{head}_{int(n_blocks)}Block_{arm}.parquet", mode)
    if csv_path:
        sinks.write_itemsets_csv(kept, csv_path, mode)
    kept.unpersist()
    return n
