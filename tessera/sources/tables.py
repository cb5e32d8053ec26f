"""Scans (S1, S2, S3, S9) and the input shapes the operators expect.

* transactions: ``tid LONG, items ARRAY<INT>`` (distinct, sorted)
* labelled vectors: ``row_id LONG, label INT, features ARRAY<DOUBLE>``

All readers are lazy DataFrame plans: column pruning and filters reach the
Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import parse_int_line
from tessera.operators.blocks import rank_within


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain Parquet scan of one of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_blocked(spark: SparkSession, path: str) -> DataFrame:
    """A blocked table written with ``partitionBy('block_id')``.

    Filters on ``block_id`` prune whole directories.
    """
    return spark.read.parquet(path)


def item_dictionary(spark: SparkSession, sf_dir: str, attribute: str) -> DataFrame:
    """``item INT, name``: the distinct values of a part attribute, numbered
    from 1 in their order.  Exact (no hash can merge two values) and ranked
    without a one-task sort."""
    names = (read_table(spark, sf_dir, "part").select(F.col(attribute).cast("string").alias("name"))
             .filter("name is not null").distinct().withColumn("_all", F.lit(0)))
    return rank_within(names, "_all", "name", "item").select(F.col("item").cast("int").alias("item"), "name")


def basket_items(spark: SparkSession, sf_dir: str, attribute: str = "p_brand") -> DataFrame:
    """(l_orderkey, item) pairs: one order line mapped to its part's attribute.

    ``p_brand`` -> the brand number ('Brand#7' -> 7); any other attribute
    (``p_type``, ``p_name``) -> its number in ``item_dictionary``.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part")
    if attribute == "p_brand":
        pt = part.select("p_partkey", F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int").alias("item"))
    else:
        pt = (part.select("p_partkey", F.col(attribute).cast("string").alias("name"))
              .join(item_dictionary(spark, sf_dir, attribute), "name", "left").select("p_partkey", "item"))
    # part is a dimension table; AQE turns this into a broadcast join only
    # when the runtime size of the part side is below the broadcast limit.
    return li.join(pt, li.l_partkey == pt.p_partkey).select("l_orderkey", "item")


def baskets(spark: SparkSession, sf_dir: str, attribute: str = "p_brand") -> DataFrame:
    """Transactions ``tid, items`` (distinct, int-sorted) per order.

    ``collect_set`` is partially aggregated map-side, and a basket can never
    hold more than the distinct item values, so even a hot order stays small.
    """
    return (basket_items(spark, sf_dir, attribute)
            .groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_set("item")).alias("items"))
            .select(F.col("l_orderkey").alias("tid"), "items"))


def read_text_transactions(spark: SparkSession, path: str) -> DataFrame:
    """S2 + P3: text file, one transaction per line of space-separated ints.

    Lines carry no id and may repeat, so ``tid`` is
    ``monotonically_increasing_id`` (stable for a given set of file splits).
    """
    df = spark.read.text(path)
    return df.select(F.monotonically_increasing_id().alias("tid"),
                     parse_int_line(F.col("value")).alias("items"))


def write_blocked_text(tx: DataFrame, path: str, mode: str = "overwrite", col: str = "block_id") -> None:
    """Transactions as text lines (space-separated ints), one directory per
    block, so a block pick prunes whole directories at the text scan."""
    from tessera.functions.exprs import itemset_text
    tx.select(col, itemset_text("items").alias("value")).write.mode(mode).partitionBy(col).text(path)


def read_blocked_text(spark: SparkSession, path: str) -> DataFrame:
    """S2 on a blocked text table: ``block_id, items`` (block from the
    directory name).  No row id is added: a non-deterministic id column
    would stop block filters from reaching the scan as partition filters."""
    df = spark.read.text(path)
    return df.select(F.col("block_id").cast("int").alias("block_id"),
                     parse_int_line(F.col("value")).alias("items"))


def text_lines_to_transactions(lines: DataFrame, tid_col: str = "tid", value_col: str = "value") -> DataFrame:
    """P3 on an in-memory line table (``tid``, ``value``)."""
    return lines.select(F.col(tid_col).alias("tid"), parse_int_line(F.col(value_col)).alias("items"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` -> ``row_id, label, features ARRAY<DOUBLE>``."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"),
                      F.col("label").cast("int").alias("label"),
                      F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def true_centers(vectors: DataFrame) -> DataFrame:
    """Mean feature vector per label: ``center_id, center``.

    The true centers the clustering arm is scored against (S9 input form,
    one row per center instead of an array of vectors).  ``Summarizer.mean``
    is partially aggregated, so a hot label costs one buffer per task.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return (vectors.groupBy("label")
            .agg(Summarizer.mean(array_to_vector("features")).alias("m"))
            .select(F.col("label").alias("center_id"), vector_to_array("m").alias("center")))


def read_centers(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A centers table ``name, centers ARRAY<ARRAY<DOUBLE>>``; ``file:key``
    picks another name (the last ``:`` after the last ``/``, so that paths with a
    scheme stay whole).  A table of several names needs a key; a key that the
    table lacks is an error.  Returns ``center_id, center`` rows for one name."""
    head, sep, tail = path.rpartition(":")
    if key is None and sep and "/" not in tail:
        path, key = head, tail
    df = spark.read.parquet(path)
    if key is not None:
        df = df.filter(F.col("name") == key)
    names = [r[0] for r in df.select("name").distinct().limit(2).collect()]
    if not names:
        raise ValueError(f"no centers named {key!r} in {path}")
    if len(names) > 1:
        raise ValueError(f"{path} holds centers of several names; give one as path:name")
    return df.select(F.posexplode("centers").alias("center_id", "center"))
