"""A stored manifest of a blocked table: which files and rows each block has.

It is a small Parquet table, one row a file, in the folder ``_manifest`` of the
blocked table, where Spark's readers of the table do not look.  It is made
from the files' footers (no column is read), and block inventories (B1) and
picks (B2-B5) then read it instead of the table: a pick lists and opens only
the directories of its blocks, not those of all blocks.

The manifest describes the files that were there when it was written.  A job
that adds or removes files writes it anew; ``manifest_changes`` tells whether
the two still agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK
from tessera.sources.tables import read_blocked

SCHEMA = "block_id INT, file STRING, n_rows BIGINT, bytes BIGINT"


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_manifest"


def write_manifest(spark: SparkSession, path: str) -> None:
    """List the files of the blocked table at ``path`` with their rows and bytes.

    One partial aggregate over the partition column and the file's name; the row counts
    come from the footers.  A table without a block (no rows were written) gets
    an empty manifest; null block ids are kept as such.
    """
    table = spark.read.schema(f"{BLOCK} INT").parquet(path)
    files = table.select(BLOCK, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    (files.groupBy(BLOCK, "file").agg(F.count(F.lit(1)).alias("n_rows"), F.max("bytes").alias("bytes"))
     .select(BLOCK, "file", "n_rows", "bytes").write.mode("overwrite").parquet(_folder(path)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, file, n_rows, bytes``."""
    return spark.read.schema(SCHEMA).parquet(_folder(path))


def stored_inventory(spark: SparkSession, path: str) -> DataFrame:
    """B1 from the manifest: ``block_id, n_rows``."""
    return read_manifest(spark, path).groupBy(BLOCK).agg(F.sum("n_rows").alias("n_rows"))


def read_blocks(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """B3 through the manifest: the rows of the listed blocks, schema as ``read_blocked``.

    Only the directories of these blocks are listed and opened.  Ids without a
    block are passed over; repeated ids count once.  At most ``len(ids)`` ids
    come back to the driver.
    """
    there = (read_manifest(spark, path).filter(F.col(BLOCK).isin(sorted({int(i) for i in ids})))
             .select(BLOCK).distinct().collect())
    if not there:
        return read_blocked(spark, path).limit(0)
    root = path.rstrip("/")
    return spark.read.option("basePath", root).parquet(*[f"{root}/{BLOCK}={r[0]}" for r in sorted(there)])


def manifest_changes(spark: SparkSession, path: str) -> DataFrame:
    """``file, change``: files that are ``new``, ``gone`` or of another size
    (``changed``) since the manifest was written; no rows when it still holds.
    The files are listed, not read."""
    now = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
           .load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("now")))
    both = read_manifest(spark, path).select("file", "bytes").join(now, "file", "full_outer")
    change = (F.when(F.col("bytes").isNull(), "new").when(F.col("now").isNull(), "gone")
              .when(F.col("bytes") != F.col("now"), "changed"))
    return both.select("file", change.alias("change")).filter("change is not null")
