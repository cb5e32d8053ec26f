"""Frequent itemsets: exact arm, block-local mining and the three merges.

Inputs are transactions ``tid, block_id, items ARRAY<INT>`` (distinct,
sorted).  Outputs use ``items ARRAY<INT>`` (int-sorted) as the key.

* F3 local mining runs **one** MLlib FP-growth over block-tagged items
  (``block_id * 2^32 + item``): an itemset can never span two blocks, every
  block is mined by the same distributed job (no whole block in one task),
  and a hot item is split into one tagged item per block.  Blocks of like
  thresholds share a run, so a tiny block's low count never applies to a
  large one.
* F4 vote / F8 sum merges are ``groupBy(items)`` aggregations (partial
  aggregation map-side).
* F7 exact recount anchors every candidate on one of its items (the rarest
  by default) and joins each transaction with the candidates anchored on
  its own items (broadcast when the candidate set is checked to be small,
  else a shuffle join with AQE skew splitting), then tests full containment
  with ``forall``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import itemset_key, tag_items, tagged_block, untag_items
from tessera.operators.block_mining import mine_blocks
from tessera.operators.blocks import BLOCK, block_inventory, hold, materialise, release

# Estimated bytes up to which recount broadcasts the candidates; above it the
# recount becomes a shuffle join on the anchor item.
BROADCAST_CANDIDATES = 64 << 20

# Blocks whose thresholds lie within this factor are mined in one run.
BAND = 1.5

# Transactions per FP-growth partition when the caller gives no count.
TX_PER_PARTITION = 500_000


def fp_partitions(spark, n_rows: int, num_partitions: int | None = None) -> int:
    """Partitions of the FP-tree stage: the caller's count, else one per
    ``TX_PER_PARTITION`` transactions and at least the default parallelism.
    (MLlib would take the input's partition count, e.g. 200 tiny trees on
    small data; its RDD shuffle is not coalesced by AQE.)"""
    if num_partitions:
        return int(num_partitions)
    try:
        floor = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext on a Connect client
        floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-int(n_rows) // TX_PER_PARTITION))


# ---------------------------------------------------------------- P5-P8, P10
def drop_singletons(itemsets: DataFrame) -> DataFrame:
    """Keep itemsets of length >= 2."""
    return itemsets.filter(F.size("items") >= 2)


def with_frequency(itemsets: DataFrame, n_rows: int) -> DataFrame:
    """``frequency = support / n_rows``."""
    return itemsets.withColumn("frequency", F.col("support") / F.lit(float(n_rows)))


def min_frequency(itemsets: DataFrame, floor: float = 0.01) -> DataFrame:
    """Keep ``frequency >= floor``."""
    return itemsets.filter(F.col("frequency") >= F.lit(float(floor)))


def with_key(itemsets: DataFrame, out: str = "itemset") -> DataFrame:
    """P5: add the canonical ``{a,b}`` key."""
    return itemsets.withColumn(out, itemset_key("items"))


def with_names(itemsets: DataFrame, names: DataFrame, out: str = "names") -> DataFrame:
    """Add the item texts in item order; ``names`` is the dictionary ``item, name``."""
    text = (itemsets.select("items").distinct().select("items", F.explode("items").alias("item"))
            .join(names, "item")
            .groupBy("items").agg(F.array_sort(F.collect_list(F.struct("item", "name"))).alias("_n"))
            .select("items", F.col("_n.name").alias(out)))
    return itemsets.join(text, "items", "left")


def text_lines(itemsets: DataFrame, value: str = "support") -> DataFrame:
    """S6 line form ``"{a,b}: n"``."""
    return itemsets.select(F.concat_ws(": ", itemset_key("items"),
                                       F.col(value).cast("string")).alias("value"))


def block_sizes(tx: DataFrame, col: str = BLOCK) -> dict[int, int]:
    """Rows per block (one row per block comes back)."""
    return {int(r[col]): int(r["n_rows"]) for r in block_inventory(tx, col).collect()}


def threshold_counts(sizes: dict[int, int], min_support: float, threshold: str = "own",
                     n_blocks: int | None = None, min_count: int = 1) -> dict[int, int]:
    """P10 on the block sizes: ``own`` = ``floor(min_support * n_b)``;
    ``average`` = ``floor(N * min_support / n_blocks)`` for every block.
    Clamped to ``min_count`` (>= 1): a zero count would make every subset
    of every basket frequent."""
    if threshold == "own":
        raw = {b: int(min_support * n) for b, n in sizes.items()}
    elif threshold == "average":
        nb = n_blocks if n_blocks is not None else len(sizes)
        avg = int(sum(sizes.values()) * min_support / nb) if nb else 0
        raw = {b: avg for b in sizes}
    else:
        raise ValueError("threshold must be 'own' or 'average'")
    return {b: max(c, int(min_count)) for b, c in raw.items()}


def local_thresholds(tx: DataFrame, min_support: float, threshold: str = "own",
                     n_blocks: int | None = None, min_count: int = 1,
                     col: str = BLOCK, sizes: dict[int, int] | None = None) -> DataFrame:
    """P10 as a table ``block_id, n_rows, threshold``."""
    sizes = sizes if sizes is not None else block_sizes(tx, col)
    thr = threshold_counts(sizes, min_support, threshold, n_blocks, min_count)
    rows = [(b, sizes[b], thr[b]) for b in sorted(sizes)]
    return tx.sparkSession.createDataFrame(rows, f"{col} INT, n_rows BIGINT, threshold BIGINT")


# ---------------------------------------------------------------------- F3
def local_itemsets(tx: DataFrame, min_support: float, threshold: str = "own",
                   n_blocks: int | None = None, min_count: int = 1,
                   num_partitions: int | None = None, col: str = BLOCK,
                   sizes: dict[int, int] | None = None,
                   blocks_per_run: int | None = None, band: float = BAND, miner: str = "bitmaps") -> DataFrame:
    """frequent itemsets of every block on its own.

    Returns ``block_id, items, support`` with ``support >= threshold_b``
    (checkpointed or persisted: mining runs once however often the result is read).

    ``miner="bitmaps"`` grows the itemsets of all blocks together
    (``block_mining``): nothing but the block sizes is on the driver, whatever the
    number of blocks and items.  ``miner="trees"``, and items that are not ints, take
    MLlib's FP-growth over block-tagged items: blocks whose thresholds lie within a factor ``band`` are mined together
    at the least of them (``threshold_bands``).  MLlib gathers the frequent
    tagged single items on the driver: a block has at most
    ``n_b * mean basket length / count`` of them, so about blocks * mean
    basket length * band / min_support, whatever the rows.
    ``blocks_per_run`` shortens that list by mining fewer blocks at once.
    """
    tx, owned = hold(tx.select(col, "items"))
    sizes = sizes if sizes is not None else block_sizes(tx, col)
    if sum(sizes.values()) == 0:
        release(tx, owned)
        return tx.sparkSession.createDataFrame([], f"{col} INT, items ARRAY<INT>, support BIGINT")
    thr = threshold_counts(sizes, min_support, threshold, n_blocks, min_count)
    if miner == "bitmaps" and int_items(tx):
        out = mine_blocks(tx, tx.sparkSession.createDataFrame(sorted(thr.items()), f"{col} INT, threshold BIGINT"), col)
        release(tx, owned)
        return out
    step = blocks_per_run or len(thr)
    groups = [g[i:i + step] for g in threshold_bands(thr, band) for i in range(0, len(g), step)]
    parts = [_mine_tagged(tx if len(groups) == 1 else tx.filter(F.col(col).isin(g)), {b: thr[b] for b in g},
                          sum(sizes[b] for b in g), num_partitions, col) for g in groups]
    # keep the (small) itemsets, release the copy of the transactions
    out = materialise(reduce(DataFrame.unionByName, parts))
    out.count()
    release(tx, owned)           # only drops a cache entry this call created
    return out


def threshold_bands(thr: dict[int, int], band: float = BAND) -> list[list[int]]:
    """Blocks in groups whose largest threshold is at most ``band`` times the least."""
    groups: list[list[int]] = []
    for b in sorted(thr, key=lambda b: (thr[b], b)):
        if groups and thr[b] <= band * thr[groups[-1][0]]:
            groups[-1].append(b)
        else:
            groups.append([b])
    return groups


def _mine_tagged(tx: DataFrame, thr: dict[int, int], n: int, num_partitions: int | None,
                 col: str) -> DataFrame:
    """One FP-growth run over block-tagged items, then per-block thresholds."""
    c = min(thr.values())
    # MLlib takes ceil(minSupport * N) as the count; (c - 0.5) / N gives c.
    fp = FPGrowth(itemsCol="items", minSupport=(c - 0.5) / n,
                  numPartitions=fp_partitions(tx.sparkSession, n, num_partitions))
    tagged = tx.select(tag_items("items", col).alias("items"))
    found = fp.fit(tagged).freqItemsets
    local = found.select(tagged_block("items").alias(col), untag_items("items").alias("items"),
                         F.col("freq").alias("support"))
    th = tx.sparkSession.createDataFrame(sorted(thr.items()), f"{col} INT, threshold BIGINT")
    # one threshold row per block: bounded by the block count
    return (local.join(F.broadcast(th), col)
            .filter(F.col("support") >= F.col("threshold"))
            .drop("threshold"))


# ---------------------------------------------------------------------- F1, F2
def int_items(tx: DataFrame) -> bool:
    return tx.schema["items"].dataType.simpleString() == "array<int>"


def exact_itemsets(tx: DataFrame, min_support: float, num_partitions: int | None = None,
                   n_rows: int | None = None, miner: str = "bitmaps") -> DataFrame:
    """exact frequent itemsets of the given rows: ``items, support, frequency``.
    The rows are one block of many chunks; ``miner="trees"``, and items that are
    not ints, take MLlib's FP-growth, as wide as the frequent items."""
    items = tx.select("items")
    n = n_rows if n_rows is not None else items.count()
    if n == 0:
        return tx.sparkSession.createDataFrame([], "items ARRAY<INT>, support BIGINT, frequency DOUBLE")
    if miner == "bitmaps" and int_items(tx):
        least = tx.sparkSession.createDataFrame([(0, max(1, math.ceil(min_support * n)))], f"{BLOCK} INT, threshold BIGINT")
        return with_frequency(mine_blocks(items.withColumn(BLOCK, F.lit(0)), least).select("items", "support"), max(n, 1))
    fp = FPGrowth(itemsCol="items", minSupport=float(min_support),
                  numPartitions=fp_partitions(tx.sparkSession, n, num_partitions))
    found = fp.fit(items).freqItemsets
    return with_frequency(found.select(F.array_sort("items").alias("items"),
                                       F.col("freq").alias("support")), max(n, 1))


def exact_by_blocks(tx: DataFrame, min_support: float, col: str = BLOCK,
                    broadcast_limit: int = BROADCAST_CANDIDATES) -> DataFrame:
    """F1 by blocks: an itemset that is frequent in the table is frequent, at
    the same share, in at least one block.  So the local itemsets hold every
    answer, and one exact recount drops the others.  The trees are (block,
    item) wide, not just as wide as the table's frequent items."""
    sizes = block_sizes(tx, col)
    n = sum(sizes.values())
    local = local_itemsets(tx, min_support, "own", col=col, sizes=sizes)
    counted = recount(tx, candidates(local, 1), n, None, broadcast_limit, item_freq=local_item_freq(local))
    return counted.filter(F.col("support") >= math.ceil(min_support * n))


# ---------------------------------------------------------------------- F4
def merge_vote(local: DataFrame, n_blocks: int, vote: float = 0.5,
               min_length: int = 2) -> DataFrame:
    """keep an itemset found in ``>= n_blocks * vote`` blocks; its
    support is the integer mean over the blocks that voted for it (not an
    estimate of the total).  Itemsets shorter than ``min_length`` are
    dropped first (the vote arm keeps length > 1)."""
    cand = local.filter(F.size("items") >= min_length) if min_length > 1 else local
    return (cand.groupBy("items")
            .agg(F.count(F.lit(1)).alias("votes"), F.sum("support").alias("_s"))
            .filter(F.col("votes").cast("double") >= F.lit(float(n_blocks) * float(vote)))
            .select("items", F.expr("_s div votes").alias("support"), "votes"))


# ---------------------------------------------------------------------- F8
def merge_sum(local: DataFrame, n_rows: int, floor: float | None = 0.01) -> DataFrame:
    """F8: add the local supports of equal itemsets over blocks (a lower
    bound: a block below its threshold adds 0), then frequency and floor."""
    out = with_frequency(local.groupBy("items").agg(F.sum("support").alias("support")), n_rows)
    return min_frequency(out, floor) if floor is not None else out


# ---------------------------------------------------------------------- F6
def local_item_freq(local: DataFrame) -> DataFrame:
    """``item, f``: summed local supports of the 1-itemsets (a lower bound
    of each item's count; enough to pick a recount anchor)."""
    return (local.filter(F.size("items") == 1)
            .groupBy(F.element_at("items", 1).alias("item"))
            .agg(F.sum("support").alias("f")))


def candidates(local: DataFrame, min_length: int = 2) -> DataFrame:
    """distinct local itemsets of length >= ``min_length``."""
    return local.filter(F.size("items") >= min_length).select("items").distinct()


# ---------------------------------------------------------------------- F7
def recount(tx: DataFrame, cands: DataFrame, n_rows: int | None = None,
            min_support: float | None = None,
            broadcast_limit: int = BROADCAST_CANDIDATES, anchor: str = "rarest",
            item_freq: DataFrame | None = None) -> DataFrame:
    """exact support of every candidate over ``tx``.

    Each candidate is anchored on one of its items: ``rarest`` (least
    frequent in ``tx``; one extra aggregate pass, smallest join) or
    ``first``.  A transaction meets only the candidates anchored on one of
    its own items and counts those it fully contains (``forall``).  The
    candidate side is broadcast when its estimated bytes are at most
    ``broadcast_limit``; otherwise both sides shuffle on the anchor (AQE
    splits a hot anchor).  Returns ``items, support, frequency`` for every
    candidate (support 0 included) unless ``min_support`` filters.

    Any anchor gives the exact answer; the anchor only sizes the join.  So
    ``item_freq`` (``item, f``), e.g. summed local 1-itemset supports, can
    replace the counting pass over ``tx``.
    """
    cands = materialise(cands.select("items").distinct())
    # an unsafe row with its hash entry, and 8 bytes an item
    n_bytes = cands.agg(F.sum(F.lit(80) + 8 * F.size("items"))).first()[0] or 0
    small = n_bytes <= broadcast_limit
    if anchor == "rarest":
        if item_freq is not None:
            freq = item_freq.select("item", F.col("f").alias("_f"))
        else:
            freq = (tx.select(F.explode("items").alias("item")).groupBy("item")
                    .agg(F.count(F.lit(1)).alias("_f")))
        per_item = cands.select("items", F.explode("items").alias("item"))
        anchored = (per_item.join(freq, "item", "left")
                    .groupBy("items")
                    .agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("item").alias("i")))
                         .alias("_a"))
                    .select("items", F.col("_a")["i"].alias("anchor")))
    elif anchor == "first":
        anchored = cands.select("items", F.element_at("items", 1).alias("anchor"))
    else:
        raise ValueError("anchor must be 'rarest' or 'first'")
    side = F.broadcast(anchored) if small else anchored
    ex = tx.select(F.col("items").alias("basket"), F.explode("items").alias("anchor"))
    hits = (ex.join(side, "anchor")
            .filter(F.forall("items", lambda x: F.array_contains(F.col("basket"), x)))
            .groupBy("items").agg(F.count(F.lit(1)).alias("support")))
    n = n_rows if n_rows is not None else tx.count()
    # hits has at most a row a candidate: the same size check decides the hint
    hits = F.broadcast(hits) if small else hits
    out = with_frequency(
        cands.join(hits, "items", "left").select("items", F.coalesce("support", F.lit(0)).alias("support")),
        max(n, 1))
    if min_support is not None:
        out = out.filter(F.col("frequency") >= F.lit(float(min_support)))
    return out
