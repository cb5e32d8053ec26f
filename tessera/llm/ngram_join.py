"""N-gram Jaccard join: which texts share most of their word shingles.

A text's set is its distinct five-word shingles; two texts link when
100 * |A n B| >= 80 * |A u B|.  The join is exact:

* Equal texts form a class first; only class representatives take part.
* Shingles are ordered rarest first by a fixed-size table of bucket counts over
  all documents (``2**bucket_bits`` counters, 2 MB; any global order is right,
  the counts only make it selective).  Linked sets share a shingle among the
  first n - ceil(0.8 n) + 1 of each (prefix filter), so texts meet on those.
* Star round: in each prefix bucket every text meets one centre, the text whose
  prefix holds the fewest rarer shingles, so a group of thousands of near
  copies costs one pair a member.  Pairs pass a length filter and a suffix
  filter (the popcount of the XOR of 512-bit parity bitmaps of the sets is a
  lower bound of their symmetric difference), are verified once on the whole
  texts, and joined to components.
* Rest round: buckets that still hold two components emit the pairs across
  components that pass the length, suffix and positional filters, once a pair.  No pair that could change a component is
  left out, and none inside one component is made.

Texts that are needed for verification are picked by a Bloom bitmap of fixed
size, so the corpus is not shuffled.

Null texts, empty texts and texts without words have no shingles and link with
nothing.  Rows that share an id count as one document.  Rows of null id get the
component of the class of their text (null if only null ids have it).  Repeated
rows give one result each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import keep, texts_of
from .components import components

WORDS64 = 8  # parity bitmap of 512 bits
BITS = [f"b{i}" for i in range(WORDS64)]


@dataclass(frozen=True)
class Params:
    k: int = 5
    percent: int = 80
    bucket_bits: int = 19


def _need(n: Column, p: Params) -> Column:
    """Smallest overlap of a set of n with any linked set."""
    return F.ceil(n * p.percent / 100)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): the size and a 128-bit signature of each
    text's shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in K.chunks(b.column(1)):
                d, w = K.shingles(data, offs, p.k)
                n = hi - lo
                s1, s2 = (K.signed(K.per_text(np.add, K.mix(w, i), d, n)) for i in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(np.bincount(d, minlength=n)), pa.array(s1), pa.array(s2)],
                    names=["doc_id", "n_shingles", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long")


def bucket_counts(docs: DataFrame, p: Params) -> np.ndarray:
    """Shingle occurrences in each hash bucket, over all documents."""
    size, shift = 1 << p.bucket_bits, np.uint64(64 - p.bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(0)):
                h, d, _, _ = K.words(data, offs)
                w, _ = K.window_hash(h, d, p.k)
                table += np.bincount((w >> shift).astype(np.int64), minlength=size)
        at = np.flatnonzero(table)
        for i in range(0, len(at), 1 << 16):
            j = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(table[j])], names=["i", "c"])

    got = docs.select("text").mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(size, np.int64)  # at most 2**bucket_bits rows
    counts[got["i"].to_numpy()] = got["c"].to_numpy()
    return np.minimum(counts, 2**31 - 1).astype(np.uint32)


def prefixes(docs: DataFrame, counts: np.ndarray, p: Params) -> DataFrame:
    """(doc_id, s1, s2, n, bitmap words, prefix): the rarest-first prefix of each
    text with words; the signature comes from the input."""
    shift = np.uint64(64 - p.bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in K.chunks(b.column(1)):
                d, w = K.shingles(data, offs, p.k)
                n = np.bincount(d, minlength=hi - lo)
                bit = (w & np.uint64(511)).astype(np.int64) + d * 512
                odd = (np.bincount(bit, minlength=512 * (hi - lo)) & 1).astype(np.uint8)
                bits = np.packbits(odd, bitorder="little").view(np.int64).reshape(-1, WORDS64)
                order = np.lexsort((w, counts[(w >> shift).astype(np.int64)], d))
                size = n - -(-n * p.percent // 100) + (n > 0)
                place = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
                pre = w[order][place < size[d]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(bits[:, i]) for i in range(WORDS64)),
                     K.int_list(K.signed(pre), size)],
                    names=["doc_id", "n", *BITS, "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, " + ", ".join(f"{c} long" for c in BITS) + ", prefix array<long>")


def _apart(x: str, y: str) -> Column:
    """Popcount of the XOR of two parity bitmaps: at most |A \\ B| + |B \\ A|."""
    out = F.lit(0)
    for c in BITS:
        out = out + F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")))
    return out


def _may_link(x: str, y: str, p: Params) -> Column:
    """Length filter and suffix filter on the sizes and bitmaps of two sets."""
    n, m, t = F.col(f"{x}n"), F.col(f"{y}n"), p.percent
    # overlap o links when (100 + t) o >= t (n + m); the sets differ in n + m - 2 o
    return ((100 * F.least(n, m) >= t * F.greatest(n, m))
            & ((100 + t) * _apart(x, y) <= (100 - t) * (n + m)))


def verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offs in K.chunks(batch.column(2)):
                size = hi - lo
                d1, w1 = K.shingles(data, offs, p.k)
                n, m, inter = np.bincount(d1, minlength=size), np.zeros(size, np.int64), np.zeros(size, np.int64)
                for lo2, hi2, data2, offs2 in K.chunks(batch.column(3).slice(lo, size)):
                    d2, w2 = K.shingles(data2, offs2, p.k)
                    d2 = d2 + lo2
                    mine = (d1 >= lo2) & (d1 < hi2)
                    d, _, c = K.unique_pairs(np.concatenate([d1[mine], d2]), np.concatenate([w1[mine], w2]))
                    inter += np.bincount(d[c == 2], minlength=size)
                    m += np.bincount(d2, minlength=size)
                ok[lo:hi] = (100 * inter >= p.percent * (n + m - inter)) & (inter > 0)
            yield batch.select([0, 1]).filter(pa.array(ok))

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _shared_buckets(sets: DataFrame) -> DataFrame:
    """(s, rep, pos, centre) of the prefix shingles of two texts or more; the
    centre is the text that has it earliest in its prefix."""
    post = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "s")).select(
        "s", "rep", (F.col("pos").cast("long") * (1 << 32) + F.col("n")).alias("pn"))
    centre = (post.groupBy("s").agg(F.count("*").alias("c"), F.min_by("rep", "pn").alias("centre"))
              .filter("c > 1").select("s", "centre"))
    return post.join(centre, "s").select("s", "rep", F.shiftright("pn", 32).cast("int").alias("pos"), "centre")


def _rest_pairs(shared: DataFrame, sets: DataFrame, label: DataFrame, p: Params) -> DataFrame:
    """Pairs of texts of different components that share a bucket and pass the
    length, suffix and positional filters."""
    mine = shared.join(label, "rep")
    open_ = (mine.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo != hi").select("s"))
    rest = mine.select("s", "rep", "pos", "label").join(open_, "s").join(sets.select("rep", "n", *BITS), "rep")
    x, y = (rest.select(*[F.col(c).alias(f"{side}_{c}") for c in rest.columns]) for side in "ab")
    on = ((F.col("a_s") == F.col("b_s")) & (F.col("a_rep") < F.col("b_rep"))
          & (F.col("a_label") != F.col("b_label")) & _may_link("a_", "b_", p))
    # the first common shingle has the least position on both sides
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return (x.join(y, on).groupBy(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), F.col("a_n").alias("n"),
                                  F.col("b_n").alias("m"))
            .agg(F.min("a_pos").alias("i"), F.min("b_pos").alias("j"))
            .filter((100 + p.percent) * left >= p.percent * (F.col("n") + F.col("m")))
            .select("a", "b").distinct())


def _verified(docs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return verify(pairs, keep(texts_of(docs, ids)), p)


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (columns doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = keep(signatures(docs, p))
    counts = bucket_counts(docs, p)
    # one row a distinct set: the smallest id stands for all equal ones
    rep = sig.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    one = rep.filter("rep is not null").select(F.col("rep").alias("doc_id"))
    sets = keep(prefixes(docs, counts, p).filter("n > 0").join(one, "doc_id", "left_semi")
                .dropDuplicates(["doc_id", "n", *BITS]).withColumnRenamed("doc_id", "rep"))
    shared = keep(_shared_buckets(sets))
    small = sets.select("rep", "n", *BITS)
    a, b = (small.select(*[F.col(c).alias(x if c == "rep" else f"{x}_{c}") for c in small.columns]) for x in "ab")
    star = (shared.filter("rep != centre")
            .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
    star = keep(star.join(a, "a").join(b, "b").filter(_may_link("a_", "b_", p)).select("a", "b").distinct())
    links = keep(_verified(docs, star, p))
    roots = components(links)
    label = sets.select("rep").distinct().join(roots, F.col("rep") == F.col("node"), "left").select(
        "rep", F.coalesce("root", "rep").alias("label"))
    more = keep(_rest_pairs(shared, sets, label, p))
    roots = components(links.union(_verified(docs, more, p)))
    of_class = rep.join(roots, F.col("rep") == F.col("node"), "left").select(
        "s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    return (sig.filter("n_shingles > 0").join(of_class, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
            .union(sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def op9(docs: DataFrame, p: Params = Params()) -> DataFrame:
    return classes(docs, p)
