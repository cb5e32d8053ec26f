"""Operator 12 [native]: line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n_docs, top), one row a line key, bucketed and sorted by
key, so that runs meet in merge joins without a shuffle.  ``LineRuns.add`` takes a
batch of (key, doc_id):

* the batch is summed to one row a key;
* it merge-anti-joins the keys that the runs hold as repeated already
  (``min_docs`` documents): those need no more counting;
* what is left becomes a run of level 0, and whenever a level has two runs they
  are merged (full outer merge join) into one of the next level, so b batches
  leave at most log2(b) + 1 runs and a key is rewritten log2(b) times.

Batches come in falling order of doc_id, hence the first run that holds a key
holds its largest document, which later batches cannot change; this is what makes
it right to leave a key out once it is known to be repeated.

Keys are md5 digests (16 bytes), so that two lines do not meet by chance at any
size.  A line of a third of all documents is one row of a run; only the last
join meets it once a document, as a shuffled merge join, which Spark splits where a
key is hot.

Defined results: a null or empty text is one empty line; a row without doc_id holds
no line for the count and keeps all its lines; rows of one doc_id are one
document; very long texts and lines are read whole; further columns are neither
read nor returned.  An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import keep, lower_ascii

#: white space that is stripped off a line
BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, BATCHES = 20, 3, 4


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


class LineRuns:
    """The runs of one dedup: bucketed tables of a database of their own, whose
    files lie below the shared folder and go with it (``close``)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{self.folder}/runs'")
        self.levels: dict[int, list[str]] = {}
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        table = f"{self.name}.run_{self.made}"
        self.made += 1
        run.select("key", "n_docs", "top").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(table)
        self.levels.setdefault(level, []).append(table)

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = a.alias("x"), b.hint("merge").alias("y")
        n = F.coalesce("x.n_docs", F.lit(0)) + F.coalesce("y.n_docs", F.lit(0))
        return x.join(y, F.col("x.key") == F.col("y.key"), "full").select(
            F.coalesce("x.key", "y.key").alias("key"), n.alias("n_docs"), F.greatest("x.top", "y.top").alias("top"))

    def runs(self) -> list[DataFrame]:
        """The present runs, oldest level first."""
        return [self.spark.table(t) for level in sorted(self.levels, reverse=True) for t in self.levels[level]]

    def add(self, batch: DataFrame) -> None:
        """Count a batch of distinct (key, doc_id); see the module's text."""
        new = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top"))
        for run in self.runs():
            new = new.join(run.filter(F.col("n_docs") >= self.min_docs).select("key").hint("merge"), "key", "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) == 2:
            old = self.levels.pop(level)
            self._write(self._merged(*[self.spark.table(t) for t in old]), level + 1)
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            level += 1

    def repeated(self) -> DataFrame:
        """(key, top) of the keys in ``min_docs`` documents or more."""
        runs = self.runs()
        out = runs[0]
        for run in runs[1:]:
            out = self._merged(out, run)
        return keep(out.filter(F.col("n_docs") >= self.min_docs).select("key", "top"))

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (key, doc_id) of the lines whose key has ``min_chars`` code
    points or more."""
    keys = F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.length(k) >= min_chars)
    return (docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
            .select("doc_id", F.explode(keys).alias("line")).select(key_hash(F.col("line")).alias("key"), "doc_id").distinct())


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                   batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(lines, repeated): distinct (key, doc_id) of all documents, and (key, top)
    of the keys in ``min_docs`` documents.  The batches are ranges of doc_id, the
    largest ids first."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs)
    parts = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", parts, 1000)).first()[0] if parts else None   # ``batches`` numbers
    later = sum((F.col("doc_id") < c).cast("int") for c in cuts) if cuts else F.lit(0)
    path = f"{runs.folder}/lines"
    lines_of(docs, min_chars).withColumn("batch", later).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("key binary, doc_id long, batch int").parquet(path)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).drop("batch"))
    repeated = runs.repeated()
    runs.close()
    return lines.drop("batch"), repeated


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_dropped and kept (the
    text without the lines that ``min_docs`` documents hold, which only the
    largest of them keeps)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    lines, repeated = repeated_lines(docs, min_chars, min_docs, batches)
    drop = (lines.join(repeated, "key").filter(F.col("doc_id") != F.col("top"))
            .groupBy("doc_id").agg(F.collect_set("key").alias("_drop")))     # at most a document's own lines
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stays = F.filter("_lines", lambda x: ~F.array_contains(F.col("_drop"), key_hash(line_key(x))))
    return (docs.join(drop, "doc_id", "left").select("doc_id", "_drop", split.alias("_lines"))
            .select("doc_id", "_lines", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(stays).alias("_kept"))
            .select("doc_id", F.size("_lines").cast("long").alias("n_lines"),
                    (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
                    F.array_join("_kept", "\n").alias("kept")))


def op12(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
