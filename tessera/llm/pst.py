"""Language-model scoring by a probabilistic suffix tree of words.

A text is a start mark and the token sequence of its words (A-Z lower-cased) and
one end token; the start mark is context only.  Outcomes are those of the base
score: the known tokens and one unknown one, so the probability of a text is a
proper product over its tokens.

Learning.  The root gives a known token its share and the unknown token the
share of words seen once, n1 (Good-Turing):

    P(a) = (1 - u) c(a) / N,   P(unknown) = u = (n1 + 1) / (N + 2)

A context is the last 1 to ``depth`` tokens (or the start of the text and what
follows).  Contexts seen ``min_context`` times or more are candidates, an absolute number,
so the tree grows with the corpus.  Each level is one pass: the (context, token) pairs whose
context is a candidate are counted in the tasks and summed in a shuffle; pairs seen ``min_pair`` times or
more are the context's own symbols, the rest of its count goes to its suffix:

    P(a | s) = (n(s, a) + b(s) P(a | suffix)) / (n(s) + alpha),   b(s) = n(s) + alpha - sum of own n(s, a)

The divergence test retains a context when its distribution raises the log
likelihood of its own occurrences over that of its longest retained suffix (in nats)

    sum of n(s, a) ln(P(a | s) / P(a | suffix)), over own symbols and the rest,  >= min_gain

A context that is not retained takes over its suffix' distribution.

Scoring.  The longest retained suffix of the tokens before is the state that gives a token's
probability.  In logarithms that is a sum of one value an n-gram: of the
token itself, of each retained context (log b / (n + alpha)), and of each of its
own symbols (what P lies above the share of the suffix).  The tree is therefore
one table (key, c, value) in the checkpoint folder, which the n-grams of the corpus meet by key.
N-grams of at least ``hot`` of all training tokens (at most (depth + 1) / hot rows) and Bloom
bitmaps of fixed size, of all others and of the retained contexts, are shipped, so n-grams
that the tree does not hold are not shuffled; where a bitmap is full, more rows are, with the same result.
N-grams are keyed by 64-bit hashes.  What is counted or looked up is shuffled in packed rows, one a task's
pending rows and range of keys: sorted keys as differences, by bytes, compressed.  The ranges grow in number
with the corpus, so a task's rows do not.

Null and empty texts consist of the end token; very long ones are walked whole, a task holds one
at a time.  Rows of null id are in fold null: they train nothing, held_out is null.  Repeated rows
give one result each; only doc_id and text are read, whatever other columns there are; empty
tables give an empty result; without training texts all counts are 0 and every token is unknown, u = 1/2.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from ..session import ensure_checkpoint_dir
from .common import bitmap, fold, in_bitmap

U64 = K.U64
START, END = K.U64(0x5354415254), K.U64(0x454E44)  # keys of the start mark and the end token
TEXTS, TOKEN = 1 << 14, 1 << 15     # a part of the corpus has at most 2 * TEXTS texts; the mark of a token's row
CHUNK = 1 << 18     # bytes of text at a time


@dataclass(frozen=True)
class Params:
    depth: int = 2
    min_context: int = 8
    min_pair: int = 2
    min_gain: float = 6.0
    alpha: float = 2.0
    hot: float = 1e-6
    bits: int = 26


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text index, place in the text) of the start mark, the words and the end token of each text."""
    h, d, _, _ = K.words(data, offs)
    n = len(offs) - 1
    size = np.bincount(d, minlength=n) + 2
    last = np.cumsum(size) - 1
    seq = np.empty(int(size.sum()), K.U64)
    doc = np.repeat(np.arange(n), size)
    place = np.arange(len(seq)) - (last - size + 1)[doc]
    seq[last], seq[last - size + 1] = END, START
    word = np.ones(len(seq), bool)
    word[last] = word[last - size + 1] = False
    seq[word] = h
    return seq, doc, place


def pair(ctx: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Key of an n-gram from those of all but its last token and all but its first."""
    return K.mix(ctx ^ K.mix(parent, 21), 22)


def grams(seq: np.ndarray, depth: int) -> list[np.ndarray]:
    """Keys of the n-grams of 1 to depth + 1 tokens that end at each place (the first ``level`` places of a
    text hold none of that level)."""
    out = [seq]
    for _ in range(depth):
        before = np.roll(out[-1], 1)
        out.append(pair(before, out[-1]))
    return out


def planes(x: np.ndarray) -> bytes:
    """x packed: first all lowest bytes, then the next, so that what is alike lies together, behind the size."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(packed: bytes, kind: type) -> np.ndarray:
    size = int(np.frombuffer(packed, np.int64, 1)[0])
    raw = pa.decompress(memoryview(packed)[8:], decompressed_size=size, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def steps(x: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(x, prepend=U64(0)))


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, U64), dtype=U64)


def buckets(total: int, size: int) -> int:
    """So many ranges of keys that each has about ``size`` of ``total`` rows: what a task holds does not grow."""
    return max(8, -(-total // size))


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n buckets begins in the sorted keys, and the end."""
    return np.searchsorted(((keys >> U64(32)) * U64(n)) >> U64(32), np.arange(n + 1).astype(U64))


def bucket(key: str, n: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(n).cast("long"), 32).cast("int")


def merged(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Add up the last column of rows of the same key, the first one; the others depend on it.  Sorted by key."""
    order = np.argsort(cols[0])
    key = cols[0][order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return [key[at], *(c[order[at]] for c in cols[1:-1]), np.add.reduceat(cols[-1][order], at, dtype=cols[-1].dtype) if len(at) else cols[-1]]


def counted(texts: DataFrame, of, n: int, longer: bool, least: int = 1, limit: int = 1 << 19) -> DataFrame:
    """(key, ctx, parent, c), for words (key, c), of the keys that ``of`` gives for a chunk ``least`` times or more
    in all.  A task adds up to ``limit`` of its rows, then sends them on, packed, one row a bucket of keys."""
    def pack(cols: list[np.ndarray]) -> pa.RecordBatch:
        at = cuts(cols[0], n)
        got = [], [], [], []
        for i in np.flatnonzero(at[1:] > at[:-1]):
            part = [c[at[i]:at[i + 1]] for c in cols]
            if longer:      # by context: its repeats are steps of 0
                order = np.argsort(part[1])
                part = [c[order] for c in part[1:]]
            for x, y in zip(got, (int(i), steps(part[0]), part[1].tobytes() if longer else b"", planes(part[-1])), strict=True):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, (pa.int32(), *[pa.binary()] * 3), strict=True)],
                                          names=["bucket", "first", "second", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(0), CHUNK):
                cols = of(data, offs)
                parts.append([*cols, np.ones(len(cols[0]), np.uint32)])
                held += len(cols[0])
                if held > limit:
                    parts = [merged([np.concatenate(x) for x in zip(*parts, strict=True)])]
                    held = len(parts[0][0])
                    if held > limit // 2:
                        yield pack(parts[0])
                        parts, held = [], 0
        if held:
            yield pack(merged([np.concatenate(x) for x in zip(*parts, strict=True)]))

    def add(rows: pa.Table) -> pa.Table:
        first = np.concatenate([unsteps(x.as_py()) for x in rows["first"]])
        c = np.concatenate([unplanes(x.as_py(), np.uint32) for x in rows["c"]]).astype(np.int64)
        if longer:
            second = np.concatenate([np.frombuffer(x.as_py(), U64) for x in rows["second"]])
            cols = merged([pair(first, second), first, second, c])
        else:
            cols = merged([first, c])
        often = cols[-1] >= least
        return pa.table([*(pa.array(K.signed(x[often])) for x in cols[:-1]), pa.array(cols[-1][often])],
                        names=["key", "ctx", "parent", "c"] if longer else ["key", "c"])

    return (texts.select("text").mapInArrow(run, "bucket int, first binary, second binary, c binary").groupBy("bucket")
            .applyInArrow(add, "key long, ctx long, parent long, c long" if longer else "key long, c long"))


def word_counts(texts: DataFrame, n: int = 8) -> DataFrame:
    """(key, c) of every word of all rows of ``texts``."""
    return counted(texts, lambda data, offs: [K.words(data, offs)[0]], n, False)


@contextmanager
def settings(spark: SparkSession):
    """The shuffle files of a query go when it ends, not when the driver happens to collect its garbage, and few texts
    or packed rows at a time go to Python."""
    names = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
             "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {x: spark.conf.get(x, None) for x in names}
    try:
        for x, value in names.items():
            spark.conf.set(x, value)
        yield
    finally:
        for x, value in before.items():
            spark.conf.unset(x) if value is None else spark.conf.set(x, value)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, as with checkpoint(), in compressed columns."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/pst-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def level(texts: DataFrame, prev: DataFrame, d: int, p: Params, folder: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of d tokens from the level before (key, c, p): the n-grams (key, c, p, value) and the
    retained contexts (ctx, n, share), value and share in log10."""
    contexts = prev.filter(F.col("c") >= p.min_context)
    may = bitmap(contexts, p.bits), bitmap(prev.filter(F.col("c") >= p.min_pair), p.bits)
    bits = p.bits

    def of(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        seq, _, place = tokens(data, offs)
        g = grams(seq, d - 1)[-1]
        at = np.flatnonzero(place >= d)
        at = at[in_bitmap(may[0], g[at - 1], bits)]
        at = at[in_bitmap(may[1], g[at], bits)]
        ctx, parent = g[at - 1], g[at]
        return [pair(ctx, parent), ctx, parent]

    seen = counted(texts, of, n, True, p.min_pair)
    rows = stored(seen.join(prev.select(F.col("key").alias("parent"), F.col("p").alias("q")), "parent"), f"{folder}/seen{d}")
    n, c, q, b = (F.col(x) for x in "ncqb")
    state = (rows.groupBy("ctx").agg(F.sum("c").alias("own"))
             .join(contexts.select(F.col("key").alias("ctx"), F.col("c").alias("n")), "ctx")
             .select("ctx", "n", (n + p.alpha - F.col("own")).alias("b")))
    every = n + p.alpha
    gain = F.sum(c * F.ln((c + b * q) / every / q)) + F.max((b - p.alpha) * F.ln(b / every))
    kept = stored(rows.join(state, "ctx").groupBy("ctx", "n", "b").agg(gain.alias("gain")).filter(F.col("gain") >= p.min_gain)
                  .select("ctx", "n", "b", F.log10(b / every).alias("share")), f"{folder}/kept{d}")
    own = F.when(F.col("share").isNull(), q).otherwise((c + b * q) / every)
    rows = rows.join(kept, "ctx", "left").select(
        "key", "c", own.alias("p"),
        F.when(F.col("share").isNull(), 0.0).otherwise(F.log10(own) - F.log10(q) - F.col("share")).alias("value"))
    return stored(rows, f"{folder}/level{d}"), kept.select("ctx", "n", "share")


@dataclass(frozen=True)
class Totals:
    """Training counts: end tokens, all tokens, kinds of tokens, and u."""
    ends: int
    total: int
    kinds: int
    unknown: float


def volume(texts: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text."""
    return texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()


def train(texts: DataFrame, p: Params = Params(), folder: str = "") -> tuple[DataFrame, Totals]:
    """The tree's table (key, words, c, value, kept) from all rows of ``texts``; c counts the n-gram, words is the
    count of a token and 0 for longer ones and the start, kept marks the retained contexts."""
    spark = texts.sparkSession
    folder = folder or _folder(spark)
    ends, size = volume(texts)
    counts = stored(word_counts(texts, buckets(size // 4, 1 << 21)), f"{folder}/words")
    n, kinds, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    t = Totals(ends, n + ends, kinds + (ends > 0), (once + 1) / (n + ends + 2))
    marks = spark.createDataFrame([(int(START), 0, ends), (int(END), ends, ends)], "key long, words long, c long")
    root = counts.select("key", F.col("c").alias("words"), "c").union(marks.filter("c > 0"))
    share = F.col("c") * ((1 - t.unknown) / max(t.total, 1))
    root = root.withColumn("p", share).withColumn("value", F.when(F.col("words") > 0, F.log10("p")).otherwise(0.0))
    none, no = F.lit(0).cast("long"), F.lit(False)
    parts, prev = [root.select("key", "words", "c", "value", no.alias("kept"))], root
    for d in range(1, p.depth + 1):
        prev, kept = level(texts, prev, d, p, folder, buckets(t.total, 1 << 20))
        parts.append(prev.filter("value != 0").select("key", none, "c", "value", no))
        parts.append(kept.select("ctx", none, "n", "share", F.lit(True)))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    out = out.groupBy("key").agg(F.max("words").alias("words"), F.max("c").alias("c"), F.sum("value").alias("value"),
                                F.max("kept").alias("kept"))
    tree = stored(out.filter("words > 0 or value != 0"), f"{folder}-tree")
    _remove(spark, folder)
    return tree, t


class Sorted:
    """Sorted keys, and where those of each of their highest bits begin."""
    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, U64(63 - len(keys).bit_length())
        self.first = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=U64) << self.shift)
        self.first = np.append(self.first, len(keys)).astype(np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each x, and whether it is there."""
        h = (x >> self.shift).astype(np.int64)
        i, end = self.first[h], self.first[h + 1]
        hit, left = np.zeros(len(x), bool), np.flatnonzero(i < end)
        while len(left):
            key, want = self.keys[i[left]], x[left]
            hit[left[key == want]] = True
            left = left[key < want]
            i[left] += 1
            left = left[i[left] < end[left]]
        return i, hit


def score(docs: DataFrame, tree: DataFrame, t: Totals, p: Params, limit: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, base and score of every row of docs.  A task gathers up to about ``limit`` n-grams of
    its texts, a part, takes the values of the hot ones itself and asks each bucket of the tree for the sums of the
    others over the part's texts, in one row: sorted keys, and the text of each (``who``, a token has bit 15).  A
    bucket meets its range of the tree and gives one row back; a part's rows are added up in one place.  The
    texts' own sums go the same way.  Rows of docs need the same order when a task runs again, as a scan's have."""
    common = max(1.0, p.hot * t.total)
    hot = tree.filter((F.col("c") >= common) | F.col("key").isin(int(START), int(END)))
    got = hot.select("key", "words", "value").toArrow()  # at most (depth + 1) / hot rows of 24 bytes
    keys = got["key"].to_numpy().view(U64)
    order = np.argsort(keys)
    count, value = got["words"].to_numpy()[order], got["value"].to_numpy()[order]
    nodes_here = Sorted(keys[order])
    may, may_ctx = bitmap(tree.filter(F.col("c") < common), p.bits), bitmap(tree.filter("kept"), p.bits)
    den, unknown = np.log10(t.total + t.kinds + 1.0), np.log10(t.unknown)
    depth, bits = p.depth, p.bits
    n_buckets = buckets(volume(docs)[1] // 4, 1 << 22)

    def part(chunks: list, number: int) -> pa.RecordBatch:
        """The rows of a part: the texts' own and one a bucket."""
        ids = pa.concat_arrays([c[0] for c in chunks])
        own = np.concatenate([c[1] for c in chunks], axis=1)
        key, who = (np.concatenate([c[i] for c in chunks]) for i in (2, 3))
        order = np.argsort(key)
        key, who = key[order], who[order]
        at = cuts(key, n_buckets)
        has = np.flatnonzero(at[1:] > at[:-1])
        to = [number % n_buckets, *has.tolist()]
        asked = [b"", *(steps(key[at[i]:at[i + 1]]) for i in has)]
        asks = [planes(np.arange(len(ids), dtype=np.uint16)), *(planes(who[at[i]:at[i + 1]]) for i in has)]
        return pa.RecordBatch.from_arrays(
            [pa.array(to, pa.int32()), pa.array([number] * len(to), pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * len(to)], pa.int32()), ids),
             pa.array([planes(own.reshape(-1)), *[b""] * len(has)], pa.binary()), pa.array(asked, pa.binary()), pa.array(asks, pa.binary())],
            names=["bucket", "part", "ids", "own", "keys", "who"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held, texts = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                b = batch.slice(first, TEXTS)
                for lo, hi, data, offs in K.chunks(b.column(1), CHUNK):
                    n = hi - lo
                    if texts + n > 2 * TEXTS or held > limit:
                        yield part(parts, number)
                        number, parts, held, texts = number + 1, [], 0, 0
                    seq, doc, place = tokens(data, offs)
                    size = np.bincount(doc, minlength=n) - 1
                    base, mine, known = -den * size, np.zeros(n), np.zeros(n, np.int64)
                    later_key, later_who, before = [], [], None
                    for d, g in enumerate(grams(seq, depth)):
                        at = np.flatnonzero(place >= d)
                        key, of = g[at], doc[at]
                        i, hit = nodes_here.find(key)
                        mine += np.bincount(of[hit], weights=value[i[hit]], minlength=n)
                        rest = ~hit & in_bitmap(may, key, bits)
                        if d == 0:
                            c = count[i[hit]]
                            base += np.bincount(of[hit], weights=np.log10(c + 1.0), minlength=n)
                            known += np.bincount(of[hit][c > 0], minlength=n)
                            new = ~hit & ~rest & (place[at] > 0)
                            mine += unknown * np.bincount(of[new], minlength=n)
                            rest &= place[at] > 0
                        else:       # a symbol of a retained context, or one itself
                            rest &= in_bitmap(may_ctx, before[at - 1], bits) | in_bitmap(may_ctx, key, bits)
                        before = g
                        later_key.append(key[rest])
                        later_who.append((of[rest] + texts).astype(np.uint16) | np.uint16(TOKEN if d == 0 else 0))
                    later_key, later_who = np.concatenate(later_key), np.concatenate(later_who)
                    ids = b.column(0).take(pa.array(np.arange(lo, hi)))     # a slice would hold the texts
                    parts.append((ids, np.array([size, known, base, mine], float), later_key, later_who))
                    held, texts = held + len(later_key) + n, texts + n
        if parts:
            yield part(parts, number)

    def look(rows: pa.Table, tree: pa.Table) -> pa.Table:
        keys = tree["key"].to_numpy().view(U64)
        order = np.argsort(keys)
        nodes, count, value = Sorted(keys[order]), tree["words"].to_numpy()[order], tree["value"].to_numpy()[order]
        out = [], [], [], []
        for number, ids, own, asked, who in zip(*(rows[x] for x in ("part", "ids", "own", "keys", "who")), strict=True):
            own, who = own.as_py(), who.as_py()
            if not own:
                key, text = unsteps(asked.as_py()), unplanes(who, np.uint16)
                token, text = text >= TOKEN, (text % TOKEN).astype(np.int64)
                i, hit = nodes.find(key)
                got = np.full(len(key), unknown) * token
                got[hit] = value[i[hit]]
                c = np.zeros(len(key), np.int64)
                c[hit] = count[i[hit]]
                c[~token] = 0
                some = np.flatnonzero(np.bincount(text))
                own = np.array([np.bincount(text, weights=x)[some] for x in (c > 0, np.log10(c + 1.0), got)])
                own, who = planes(own.reshape(-1)), planes(some.astype(np.uint16))
            for x, y in zip(out, (number, ids, own, who), strict=True):
                x.append(y.as_py() if isinstance(y, pa.Scalar) else y)
        return pa.table([pa.array(x, f) for x, f in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)],
                        names=["part", "ids", "own", "who"])

    def add(rows: pa.Table) -> pa.Table:
        ids = rows["ids"].combine_chunks().flatten()
        sums = np.zeros((4, len(ids)))
        for own, who in zip(rows["own"], rows["who"], strict=True):
            who = unplanes(who.as_py(), np.uint16)
            got = unplanes(own.as_py(), float).reshape(-1, len(who))
            sums[4 - len(got):, who] += got
        return pa.table([ids, pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                        names=["doc_id", "n_tokens", "n_known", "base", "score"])

    asks = docs.select("doc_id", "text").mapInArrow(run, "bucket int, part long, ids array<long>, own binary, keys binary, who binary")
    nodes = tree.filter(F.col("c") < common).select("key", "words", "value", bucket("key", n_buckets).alias("bucket"))
    return (asks.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(look, "part long, ids array<long>, own binary, who binary")
            .groupBy("part").applyInArrow(add, "doc_id long, n_tokens long, n_known long, base double, score double"))


def lm_scores(docs: DataFrame, learn, p: Params = Params()) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every row of docs
    (doc_id, text); ``learn`` is the condition of the training rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with settings(docs.sparkSession):
        folder = _folder(docs.sparkSession)
        tree, t = train(docs.filter(learn), p, folder)
        scores = stored(score(docs, tree, t, p), f"{folder}-scores")
        _remove(docs.sparkSession, f"{folder}-tree")
    return scores.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(t.total)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")


def op6(docs: DataFrame, p: Params = Params()) -> DataFrame:
    s = lm_scores(docs, fold(F.col("doc_id"), 7) != 2, p)
    return s.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                    "train_tokens", "base_score", "score")
