"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased runs of letters and digits.  Each fixed mask (a span of
five words of which one is ignored) hashes every position of the
documents and of the benchmark, so a substituted word hides only the masks
that look at it.  No overlap that the rule below accepts is hidden from all
masks: 80 per cent equal words of 5 to 15 leave a block of five words with at
most one changed, and there is a mask for each place of it.  Document hashes are first looked up in a fixed-size bitmap
of the benchmark's hashes inside the scan; the few that remain are joined to
the benchmark's hash table.  A hit names a diagonal (document position minus
item position).  An accepted stretch has a least number of hit positions, found by
enumeration (``least_hits``); diagonals with fewer are dropped before texts are
fetched.  On the others the aligned words are compared: the pair is
verified when some stretch of ``window`` aligned words (the whole item if it
is shorter) has at least ``percent`` per cent equal words.

Items of fewer words than a mask are hashed whole (none with the given masks);
items of fewer than ``min_words`` words are no evidence and are not searched.  Null texts, empty texts and
items without words hit nothing.  Rows that share a doc_id (or item_id) count
as one; rows of null ids are left out of the result, as it names ids.
Repeated rows give the pair once; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bitmap, in_bitmap, keep, texts_of


@dataclass(frozen=True)
class Params:
    #: 1: the word counts, 0: it is ignored
    masks: tuple[str, ...] = ("11110", "01111", "11011", "10111", "11101")
    window: int = 15
    percent: int = 80
    min_words: int = 5
    bitmap_bits: int = 25

    @property
    def span(self) -> int:
        return len(self.masks[0])


def least_hits(n: int, p: Params) -> int:
    """The least number of positions at which some mask matches, over all patterns
    that ``overlap`` accepts of an item of n words; 0: some pattern is missed."""
    n = min(n, p.window)
    wrong = n - -(-n * p.percent // 100)
    least = n
    for out in combinations(range(n), wrong):  # fewer changes have no fewer matches
        least = min(least, sum(any(all(c == "0" or a + j not in out for j, c in enumerate(mask)) for mask in p.masks)
                               for a in range(n - p.span + 1)))
    return least


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, d, _, _ = K.words(data, offs, K.ALNUM)
    return h, d


def seeds(h: np.ndarray, d: np.ndarray, p: Params, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hash, start word, 0) for each mask; (hash, start word, n) for whole
    sequences of the lengths n in ``short``."""
    for i, mask in enumerate(p.masks):
        m = len(h) - p.span + 1
        if m > 0:
            at = np.flatnonzero(d[:m] == d[p.span - 1:])
            acc = np.zeros(len(at), dtype=K.U64)
            for j, bit in enumerate(mask):
                if bit == "1":
                    acc = acc * K.U64(K._BASE) + h[at + j]
            yield K.mix(acc, 100 + i), at, 0
    for n in short:
        w, at = K.window_hash(h, d, n)
        yield K.mix(w, 200 + n), at, n


def benchmark_seeds(bench: DataFrame, p: Params) -> DataFrame:
    """(key, item_id, pos, words) of every seed of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in K.chunks(b.column(1)):
                h, d = tokens(data, offs)
                n = np.bincount(d, minlength=hi - lo)
                first = np.searchsorted(d, np.arange(hi - lo))
                short = tuple(int(x) for x in np.unique(n[(n >= p.min_words) & (n < p.span)]))
                for k, at, whole in seeds(h, d, p, short):
                    if whole:
                        k, at = k[n[d[at]] == whole], at[n[d[at]] == whole]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(K.signed(k)), ids.take(pa.array(lo + d[at])), pa.array(at - first[d[at]]),
                         pa.array(n[d[at]])], names=["key", "item_id", "pos", "words"])
    return bench.select("item_id", "text").mapInArrow(run, "key long, item_id long, pos long, words long")


def hits(docs: DataFrame, words: np.ndarray, short: tuple[int, ...], p: Params) -> DataFrame:
    """(key, doc_id, at) of the document seeds that the bitmap lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in K.chunks(b.column(1)):
                h, d = tokens(data, offs)
                first = np.searchsorted(d, np.arange(hi - lo))
                for k, at, _ in seeds(h, d, p, short):
                    ok = in_bitmap(words, k, p.bitmap_bits)
                    k, at = k[ok], at[ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(K.signed(k)), ids.take(pa.array(lo + d[at])), pa.array(at - first[d[at]])],
                        names=["key", "doc_id", "at"])
    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, at long")


def overlap(doc: np.ndarray, item: np.ndarray, diag: int, p: Params) -> tuple[int, int, int] | None:
    """(equal words, first, last) of the verified stretch on a diagonal, or None:
    the union of all windows that reach the percentage."""
    lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
    n = min(len(item), p.window)
    if n == 0 or hi - lo < n:
        return None
    same = item[lo:hi] == doc[lo + diag:hi + diag]
    c = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(100 * (c[n:] - c[:-n]) >= p.percent * n)
    if len(good) == 0:
        return None
    inside = np.zeros(len(same) + 1, np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + n, -1)
    covered = np.cumsum(inside[:-1]) > 0
    return int((same & covered).sum()), int(lo + diag + good[0]), int(lo + diag + good[-1] + n - 1)


def contaminated(docs: DataFrame, bench: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, n_equal, first_word, last_word) of the verified pairs;
    of several stretches the one with most equal words (then the first)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    table = keep(benchmark_seeds(bench, p).distinct())
    short = tuple(r[0] for r in table.filter(f"words < {p.span}").select("words").distinct().collect())  # below the span
    words = bitmap(table, p.bitmap_bits)
    least = F.lit(1)
    for n in range(p.span, p.window + 1):
        least = F.when(F.col("words") >= n, max(1, least_hits(n, p))).otherwise(least)
    cand = (hits(docs, words, short, p).join(table, "key")
            .groupBy("doc_id", "item_id", "words", (F.col("at") - F.col("pos")).alias("diag"))
            .agg(F.size(F.collect_set("pos")).alias("hit")).filter(F.col("hit") >= least)
            .groupBy("doc_id", "item_id").agg(F.collect_set("diag").alias("diags")))
    cand = keep(cand)
    texts = texts_of(docs, cand.select(F.col("doc_id").alias("id")).distinct())
    items = bench.groupBy("item_id", F.xxhash64("text")).agg(F.first("text").alias("item")).select("item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc, item = (_one(b.column(c)[i].as_py()) for c in (2, 3))
                found = [x for g in sorted(b.column(4)[i].as_py()) if (x := overlap(doc, item, g, p))]
                if found:
                    n, s, e = min(found, key=lambda x: (-x[0], x[1]))
                    out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), n, s, e))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "item_id", "n_equal", "first_word", "last_word"])

    pairs = cand.join(texts.withColumnRenamed("id", "doc_id"), "doc_id").join(items, "item_id")
    return (pairs.select("doc_id", "item_id", "text", "item", "diags")
            .mapInArrow(run, "doc_id long, item_id long, n_equal long, first_word long, last_word long")
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", -F.col("first_word"), "last_word")).alias("m"))
            .select("doc_id", "item_id", "m.n_equal", (-F.col("m.col2")).alias("first_word"), "m.last_word"))


def _one(text: str | None) -> np.ndarray:
    col = pa.array([text or ""])
    for _, _, data, offs in K.chunks(col):
        return tokens(data, offs)[0]
    return np.zeros(0, K.U64)


def clean(docs: DataFrame, bench: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the contaminated documents."""
    bad = contaminated(docs, bench, p).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def op2(docs: DataFrame, bench: DataFrame, p: Params = Params()) -> DataFrame:
    return contaminated(docs, bench, p)
