"""Operator 11: importance resampling towards a target text set, with features
hashed by a position table of CRC-32.

CRC-32 is affine: the checksum of a span is the XOR of one number for each of
its bytes, which depends on the byte and its distance from the end only, and of a
constant of the span's length.  ``PositionTable`` holds these numbers for
``WIDTH`` distances.  The bytes of all feature spans of a chunk are gathered at
once, looked up, and folded by one ``bitwise_xor.reduceat``.  Spans over
``WIDTH`` bytes are cut into blocks from their end; each block is folded the same
way and the blocks are folded in pairs, the left one moved on by the width of
the right, so a span of n blocks takes log2(n) steps.

The bucket counts of all documents and of the target texts (at most ``BUCKETS``
rows, whatever the corpus) give the gain of a bucket; a second pass sums the gains of
each document's features.  The drawn documents are the highest scores: their lowest
score is found by counting (``exact`` at any size), and only they are ordered, by a
range partitioning.

Defined results: a null or empty text has no feature, weight 0, and fewer than
20 words, so it is never drawn; a null doc_id draws as the empty id and ranks behind
all others of its score; repeated rows are judged each; texts and words of
any length are read whole; further columns are neither read nor returned.  An
empty table gives an empty table, an empty target set equal gains by count alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .kernel import ALNUM, LOWER, chunks, per_text, runs

BUCKETS = 10_000
N_WORDS = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: distances from the end in the table; bytes of spans looked up at once; bytes of text in a chunk
WIDTH, AT_ONCE, CHUNK = 64, 1 << 20, 1 << 18


class PositionTable:
    """CRC-32 of many spans of one byte array."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        zeros = [zlib.crc32(bytes(n)) for n in range(width + 1)]
        #: [distance from the end, byte]
        self.table = np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zeros[d + 1] for b in range(256)]
                               for d in range(width)], dtype=np.uint32)
        self.zeros = np.array(zeros, dtype=np.uint32)
        ahead = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
        for _ in range(width):
            ahead = (ahead >> np.uint32(8)) ^ self.table[0][ahead & np.uint32(255)]
        #: moves[k] moves a value on by width * 2^k zero bytes, as four tables of its bytes
        self.moves = [ahead]

    def _move(self, values: np.ndarray, k: int) -> np.ndarray:
        while len(self.moves) <= k:
            self.moves.append(self._move(self.moves[-1], len(self.moves) - 1))
        t, b = self.moves[k], np.uint32(255)
        return (t[0][values & b] ^ t[1][(values >> np.uint32(8)) & b]
                ^ t[2][(values >> np.uint32(16)) & b] ^ t[3][values >> np.uint32(24)])

    def constant(self, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of so many zero bytes."""
        if not len(lengths) or int(lengths.max()) <= self.width:
            return self.zeros[lengths]
        known, at = np.unique(lengths, return_inverse=True)
        return np.array([self.zeros[n] if n <= self.width else zlib.crc32(bytes(n)) for n in known.tolist()], np.uint32)[at]

    def _fold(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR of the contributions of spans of 1 to ``width`` bytes."""
        size = ends - starts
        total = np.cumsum(size)
        out = np.empty(len(starts), np.uint32)
        lo = 0
        while lo < len(starts):
            done = total[lo] - size[lo]
            hi = max(lo + 1, int(np.searchsorted(total, done + AT_ONCE, side="right")))
            n = size[lo:hi]
            first = total[lo:hi] - n - done
            to_end = (np.repeat((first + n - 1).astype(np.int32), n) - np.arange(int(n.sum()), dtype=np.int32))
            byte = data[np.repeat(ends[lo:hi] - 1, n) - to_end]
            out[lo:hi] = np.bitwise_xor.reduceat(self.table.ravel()[(to_end << 8) | byte], first)
            lo = hi
        return out

    def crc(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of every (non-empty) span."""
        if not len(starts):
            return np.zeros(0, np.uint32)
        size = ends - starts
        n = -(-size // self.width)
        span = np.repeat(np.arange(len(starts)), n)
        left = np.cumsum(n)[span] - 1 - np.arange(len(span))           # blocks to the right of this one
        e = ends[span] - left * self.width
        value = self._fold(data, np.maximum(starts[span], e - self.width), e)
        step = 0
        while len(span) > len(starts):
            odd = (left & 1).astype(bool)
            value[odd] = self._move(value[odd], step)
            left = left >> 1
            at = np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (left[1:] != left[:-1])))
            value, span, left, step = np.bitwise_xor.reduceat(value, at), span[at], left[at], step + 1
        return value ^ self.constant(size)


def features(data: np.ndarray, offs: np.ndarray, n_words: int = N_WORDS):
    """Of the texts of a chunk: (spaced bytes, start, end, text index) of all runs of 1
    to ``n_words`` words, and the number of words of each text.  Words are joined by
    one space in the spaced bytes."""
    low = LOWER[data]
    stays = ALNUM[low]
    s, e, d = runs(stays, offs)
    gap = e[e < len(low)]
    gap = gap[~stays[gap]]                      # a word that ends its text has no gap to write to
    low[gap] = 32
    stays[gap] = True
    new = s - np.cumsum(np.append(0, ~stays))[s]
    end = new + (e - s)
    parts = [(new, end, d)]
    for k in range(1, n_words):
        at = np.flatnonzero(d[:-k] == d[k:]) if len(d) > k else np.zeros(0, np.int64)
        parts.append((new[at], end[at + k], d[at]))
    starts, ends, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return low[stays], starts, ends, texts, np.bincount(d, minlength=len(offs) - 1)


def _buckets(texts: pa.Array, table: PositionTable, buckets: int) -> Iterator[tuple]:
    """(first row, end row, bucket, text index, words) chunk by chunk."""
    for lo, hi, data, offs in chunks(texts, CHUNK):
        spaced, s, e, d, words = features(data, offs)
        yield lo, hi, (table.crc(spaced, s, e) % np.uint32(buckets)).astype(np.int64), d, words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (column ``text``) by bucket; a task hands on one row
    a bucket at most, and so does the aggregate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = PositionTable(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, b, _, _ in _buckets(batch.column(0), table, buckets):
                n += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    got = (texts.select("text").mapInArrow(run, "bucket int, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())     # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    s, t, b = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log(((t + 1) * (float(source.sum()) + b)) / ((s + 1) * (float(target.sum()) + b)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_features, weight of every row; the gains (8 bytes a
    bucket) go to the tasks with the function."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PositionTable()
        for batch in batches:
            cols = np.zeros((3, len(batch)), np.int64)
            for lo, hi, b, d, words in _buckets(batch.column(1), table, len(gain)):
                order = np.argsort(d, kind="stable")
                cols[0, lo:hi], cols[1, lo:hi] = words, np.bincount(d, minlength=hi - lo)
                cols[2, lo:hi] = per_text(np.add, gain[b[order]], d[order], hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)],
                                             names=[key, "n_words", "n_features", "weight"])

    return (docs.select(F.col(key).cast("long").alias(key), "text")
            .mapInArrow(run, f"`{key}` long, n_words long, n_features long, weight long"))


def lowest_of_top(rows: DataFrame, col: str, k: int, bins: int = 4096) -> int | None:
    """The k-th highest value of an integer column, by counting in ever finer
    bins; a pass returns at most ``bins`` rows."""
    lo, hi = rows.agg(F.min(col), F.max(col)).first()
    if k < 1 or lo is None:
        return None
    while lo < hi:
        step = -(-(hi - lo + 1) // bins)
        at = F.expr(f"(`{col}` - ({lo}L)) div {step}L")
        got = rows.filter(F.col(col).between(lo, hi)).groupBy(at.alias("b")).count().collect()
        for b, n in sorted(got, reverse=True):
            if n >= k:
                lo, hi = lo + b * step, min(hi, lo + (b + 1) * step - 1)
                break
            k -= n
    return lo


def ranked(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Numbers the rows 1, 2, 3... in a global order: ordered ranges, checkpointed
    so that both reads see the same ones, and the number of rows before each range."""
    parts = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = before.select("_part", "_first", F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))   # a row a partition
    return (parts.join(F.broadcast(before), "_part")
            .withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_at") - F.col("_first") + 1)
            .drop("_part", "_at", "_before", "_first"))


def select(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED,
           min_words: int = MIN_WORDS) -> DataFrame:
    """Of every document: doc_id, n_words, n_features, weight, score (weight and
    Gumbel noise of the id) and rank (null: not drawn)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = keep(weigh(docs, gain).withColumn("score", F.col("weight") + noise))
    fit = F.col("n_words") >= min_words
    k = percent * scored.filter(fit).count() // 100
    cut = lowest_of_top(scored.filter(fit), "score", k)
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = fit & (F.col("score") >= cut)
    top = ranked(scored.filter(high), [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features")])
    return (top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
            .unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long"))))


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    return select(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
