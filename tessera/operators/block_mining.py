"""frequent itemsets of all blocks, grown prefix by prefix together.

Equal baskets of a block are one row with a weight, so that no basket is hot, and
the rows are dealt to chunks.  A step gives a chunk its block's frequent itemsets
of one length; the chunk finds their rows by AND-ing bitmaps of the items and
counts the items that follow them, Spark adds the counts, and those that reach
the block's threshold are the itemsets of the next length.  So a step is one job
for all blocks, a block of any size spreads over its chunks, and neither items
nor itemsets pass through the driver.  A block that fits one chunk takes all its
steps in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK, materialise
from tessera.operators.lockstep import CHUNK_ROWS, Dealt, checkpointed, deal

#: (row, item) pairs counted at once
PAIRS = 1 << 21


class Baskets:
    """The baskets of a chunk: items as numbers 0..k-1 in ascending order, one bitmap an item."""

    def __init__(self, rows: pa.Table, kept: np.ndarray | None = None):
        lists = rows["items"].combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if kept is not None:
            some = np.isin(values, kept)
            values, row = values[some], row[some]
        self.weight = rows["w"].to_numpy().astype(float)
        self.ids, number = np.unique(values, return_inverse=True)
        pair = np.unique(row * max(1, len(self.ids)) + number)           # an item counts once a basket
        self.row, self.item = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
        n = len(lists)
        self.first = np.searchsorted(self.row, np.arange(n + 1))
        bits = np.zeros((len(self.ids), n), bool)
        bits[self.item, self.row] = True
        self.bits = np.packbits(bits, axis=1)
        self.n = n

    def numbers(self, sets: np.ndarray) -> np.ndarray:
        """The item numbers of the itemsets whose items all occur here."""
        if not len(self.ids):
            return np.zeros((0, sets.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(self.ids, sets), len(self.ids) - 1)
        return at[(self.ids[at] == sets).all(axis=1)]

    def following(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the set, following item, weight) for sets of item numbers: how
        often each item behind a set's last one occurs with it."""
        out, k = [], max(1, len(self.ids))
        length = np.diff(self.first)
        lo = 0
        while lo < len(sets):
            hi = lo + max(1, PAIRS // max(1, self.n))
            part = sets[lo:hi]
            found = self.bits[part[:, 0]]
            for j in range(1, part.shape[1]):
                found = found & self.bits[part[:, j]]
            which, row = np.nonzero(np.unpackbits(found, axis=1, count=self.n))
            sizes = np.cumsum(length[row])
            start = 0
            while start < len(row):
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + PAIRS, side="right")))
                w, r = which[start:stop], row[start:stop]
                n = length[r]
                at = np.repeat(self.first[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                owner, item = np.repeat(w, n), self.item[at]
                behind = item > part[owner, -1]
                key, of = np.unique((owner[behind] + lo) * k + item[behind], return_inverse=True)
                out.append((key, np.bincount(of, weights=np.repeat(self.weight[r], n)[behind], minlength=len(key))))
                start = stop
            lo = hi
        if not out:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        key, of = np.unique(np.concatenate([k_ for k_, _ in out]), return_inverse=True)
        return key // k, key % k, np.bincount(of, weights=np.concatenate([n for _, n in out]))

    def single(self) -> np.ndarray:
        return np.bincount(self.item, weights=self.weight[self.row], minlength=len(self.ids))


def _lists(sets: np.ndarray) -> pa.Array:
    offsets = np.arange(0, sets.size + 1, max(1, sets.shape[1])) if sets.size else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.ravel(), pa.int32()))


def _table(col: str, block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """(block, items, support) of pairs (itemsets of one length, weights)."""
    parts = [p for p in parts if len(p[0])] or [(np.zeros((0, 1), np.int64), np.zeros(0))]
    items = pa.chunked_array([_lists(s) for s, _ in parts], pa.list_(pa.int32()))
    n = np.concatenate([n for _, n in parts])
    return pa.table({col: pa.array(np.full(len(n), block), pa.int32()), "items": items, "support": pa.array(np.rint(n).astype(np.int64))})


def _mine(baskets: Baskets, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All frequent itemsets of a whole block, (sets, weights) by length."""
    n = baskets.single()
    some = np.flatnonzero(n >= least)
    sets, out = some[:, None], [(baskets.ids[some][:, None], n[some])]
    while len(sets):
        at, item, n = baskets.following(sets)
        some = np.flatnonzero(n >= least)
        sets = np.hstack([sets[at[some]], item[some][:, None]])
        out.append((baskets.ids[sets] if len(sets) else np.zeros((0, 1), np.int64), n[some]))
    return out


def mine_blocks(tx: DataFrame, thresholds: DataFrame, col: str = BLOCK, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``block, items (ascending), support`` of the itemsets of rows ``block,
    items`` that reach the ``threshold`` (at least 1) of their block."""
    kind = f"{col} int, items array<int>, support long"
    baskets = (tx.filter(F.size("items") > 0).groupBy(F.col(col).cast("int").alias(col), F.array_sort("items").alias("items"))
               .agg(F.count(F.lit(1)).alias("w")))
    thresholds = thresholds.select(F.col(col).cast("int").alias(col), F.col("threshold").cast("long").alias("threshold"))
    baskets = materialise(baskets)
    dealt = deal(baskets, "items", col, chunk_rows)
    dealt.chunks.count()
    baskets.unpersist()
    whole, large = dealt.split()

    def all_lengths(rows: pa.Table, state: pa.Table) -> pa.Table:
        if not len(rows) or not len(state):
            return _table(col, 0, [])
        kept = Baskets(rows)
        least = max(1, state["threshold"][0].as_py())
        frequent = kept.ids[kept.single() >= least]
        return _table(col, rows[col][0].as_py(), _mine(Baskets(rows, frequent), least))

    out = checkpointed(whole.step(thresholds, all_lengths, kind))
    if large.any():
        out = checkpointed(out.unionByName(_mined_by_length(large, thresholds, kind)))
    dealt.release()
    return out


def _mined_by_length(dealt: Dealt, thresholds: DataFrame, kind: str) -> DataFrame:
    """The same for blocks of many chunks, a job a length."""
    col = dealt.col

    def behind(size: int):
        def next_length(rows: pa.Table, state: pa.Table) -> pa.Table:
            length = state["items"].combine_chunks().value_lengths().to_numpy()
            if not len(rows) or not (length == size).any():
                return _table(col, 0, [])
            singles = state.filter(pa.array(length == 1))["items"].combine_chunks().flatten().to_numpy()
            longest = state.filter(pa.array(length == size))["items"].combine_chunks()
            kept = Baskets(rows, singles)
            sets = kept.numbers(longest.flatten().to_numpy().reshape(-1, size).astype(np.int64))
            at, item, n = kept.following(sets)
            new = np.hstack([sets[at], item[:, None]])
            return _table(col, rows[col][0].as_py(), [(kept.ids[new] if len(new) else new, n)])

        return next_length

    least = F.broadcast(thresholds)                        # 12 bytes a block

    def frequent(counts: DataFrame) -> DataFrame:
        return (counts.groupBy(col, "items").agg(F.sum("support").alias("support")).join(least, col)
                .filter(F.col("support") >= F.greatest("threshold", F.lit(1))).drop("threshold"))

    singles = (dealt.rows.select(col, F.explode(F.array_distinct("items")).alias("i"), F.col("w").alias("support"))
               .groupBy(col, "i").agg(F.sum("support").alias("support")).select(col, F.array("i").alias("items"), "support"))
    out = last = checkpointed(frequent(singles))
    singles, size = last, 1
    while last.limit(1).count():
        state = last.select(col, "items") if size == 1 else last.select(col, "items").unionByName(singles.select(col, "items"))
        last = checkpointed(frequent(dealt.step(state, behind(size), kind)))
        out, size = out.unionByName(last), size + 1
    return out


def supports_by_block(tx: DataFrame, itemsets: DataFrame, col: str = BLOCK, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``block, items, support``: how often each of ``itemsets`` (``items``,
    ascending) occurs in every block that holds it, in one job."""
    baskets = materialise(tx.filter(F.size("items") > 0).groupBy(F.col(col).cast("int").alias(col), F.array_sort("items").alias("items"))
                          .agg(F.count(F.lit(1)).alias("w")))
    dealt = deal(baskets, "items", col, chunk_rows)
    state = itemsets.select("items").distinct().crossJoin(F.broadcast(dealt.sizes.select(col)))     # 4 bytes a block

    def count(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(rows) or not len(wanted):
            return _table(col, 0, [])
        lists = wanted["items"].combine_chunks()
        length = lists.value_lengths().to_numpy()
        kept, parts = Baskets(rows, np.unique(lists.flatten().to_numpy())), []
        for size in np.unique(length[length > 0]):
            sets = kept.numbers(lists.filter(pa.array(length == size)).flatten().to_numpy().reshape(-1, size).astype(np.int64))
            n = np.zeros(len(sets))
            step = max(1, PAIRS // max(1, kept.n))
            for lo in range(0, len(sets), step):
                found = np.bitwise_and.reduce(kept.bits[sets[lo:lo + step]], axis=1)
                n[lo:lo + step] = np.unpackbits(found, axis=1, count=kept.n) @ kept.weight
            parts.append((kept.ids[sets[n > 0]] if len(sets) else sets, n[n > 0]))
        return _table(col, rows[col][0].as_py(), parts)

    found = dealt.step(state, count, f"{col} int, items array<int>, support long")
    out = checkpointed(found.groupBy(col, "items").agg(F.sum("support").alias("support")))
    dealt.release()
    baskets.unpersist()
    return out
