"""Reading, sampling and checkpoint helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: white space between words
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage; a lost
    executor costs a re-read, not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, mod parts (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOW)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    where: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of at most ``rows`` labelled rows, chosen by a hash of the
    key, so the same rows are taken at every partitioning.  A key labelled
    twice counts once (the larger label).  This is the one place where a
    classifier is fitted on a bounded sample."""
    y = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
         .filter(F.lit(True) if where is None else where)
         .groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("y"))
         .orderBy(F.xxhash64("_k", F.lit("sample")), "_k").limit(rows))
    return (docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
            .join(F.broadcast(y), "_k")  # at most ``rows`` rows of 12 bytes
            .groupBy("_k", "y").agg(F.min("_t").alias("text"))
            .select(F.col("_k").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "y"))


def collect_sample(sample: DataFrame) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """(texts, labels, keys) of a bounded labelled sample, in key order."""
    t = sample.orderBy("key").select("key", "text", "y").toArrow()
    release()
    return t["text"], t["y"].to_numpy().astype(float), t["key"].to_numpy()


def release() -> None:
    """Give freed memory back to the system (Arrow's, and glibc's where that is
    the C library): the driver is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bitmap(keys: DataFrame, bits: int, key: str = "key") -> np.ndarray:
    """A one-hash Bloom bitmap of 64-bit keys: ``2**bits`` bits whatever their
    number, OR-ed in the tasks; at most ``2**(bits-6)`` words reach the driver."""
    got = (keys.select(F.shiftrightunsigned(key, 64 - bits).alias("h"))
           .selectExpr("cast(shiftrightunsigned(h, 6) as int) as w", "shiftleft(1L, cast(h & 63 as int)) as m")
           .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow())
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got["w"].to_numpy()] = got["m"].to_numpy()
    return words.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """May the (unsigned 64-bit) keys be in the bitmap?"""
    h = keys >> np.uint64(64 - bits)
    return ((words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def texts_of(docs: DataFrame, ids: DataFrame, bits: int = 26) -> DataFrame:
    """(id, text) of the documents (doc_id, text) whose id is in ``ids``, one row
    a distinct text.  A Bloom bitmap of fixed size picks the rows in the scan,
    so that the other texts are not shuffled; a join drops its false hits."""
    words = bitmap(ids.select(F.xxhash64("id").alias("key")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = in_bitmap(words, b.column(2).to_numpy().view(np.uint64), bits)
            yield b.select([0, 1]).filter(pa.array(hit))

    some = (docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
            .filter("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(run, "id long, text string"))
    return (some.join(ids, "id", "left_semi")
            .groupBy("id", F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text")).select("id", "text"))
