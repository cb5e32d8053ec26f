"""The stored manifest of a blocked table and the plans that rest on it."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.sources import manifest_changes, read_blocked, read_blocks, read_manifest, stored_inventory, write_manifest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    """5,000 rows in 6 blocks, some in several files, in a folder whose name must be encoded in a URI."""
    path = str(tmp_path / "a table")
    rows = spark.range(5000).select("id", F.repeat(F.lit("x"), 20).alias("pad"))
    B.write_blocked(B.assign_blocks(rows, "id", 6, 3).repartition(3), path)
    write_manifest(spark, path)
    return path


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_manifest_is_the_inventory(spark, table):
    whole = read_blocked(spark, table)
    assert "file" not in whole.columns and whole.count() == 5000      # the manifest is not read as data
    assert _rows(stored_inventory(spark, table)) == _rows(B.block_inventory(whole))
    files = read_manifest(spark, table)
    assert files.select("file").distinct().count() == files.count() > 6
    assert files.agg(F.min("bytes")).first()[0] > 0
    assert all("/_manifest/" in f for f in stored_inventory(spark, table).inputFiles())     # no data file is opened


def test_read_blocks_lists_only_the_blocks(spark, table):
    whole = read_blocked(spark, table)
    got = read_blocks(spark, table, [4, 1, 4, 99])
    assert got.schema == whole.schema
    assert _rows(got) == _rows(B.blocks_by_ids(whole, [1, 4]))
    assert {re.search("block_id=([0-9]+)", f)[1] for f in got.inputFiles()} == {"1", "4"}
    for none in ([], [99]):
        assert read_blocks(spark, table, none).schema == whole.schema and read_blocks(spark, table, none).count() == 0


def test_manifest_changes(spark, table):
    assert manifest_changes(spark, table).count() == 0
    more = spark.range(5000, 5100).select("id", F.lit("y").alias("pad"))
    B.write_blocked(B.assign_blocks(more, "id", 1, 3), table, mode="append")
    found = manifest_changes(spark, table).collect()
    assert found and {r.change for r in found} == {"new"} and all("block_id=0" in r.file for r in found)
    write_manifest(spark, table)
    assert manifest_changes(spark, table).count() == 0
    assert _rows(stored_inventory(spark, table)) == _rows(B.block_inventory(read_blocked(spark, table)))
    spark.range(1).write.parquet(table + "/block_id=77")
    write_manifest(spark, table)
    B.write_blocked(B.assign_blocks(more, "id", 1, 3), table)          # written anew: the manifest goes with the old files
    write_manifest(spark, table)
    assert _rows(stored_inventory(spark, table)) == [(0, 100)]


def test_odd_tables(spark, tmp_path):
    empty, null = str(tmp_path / "empty"), str(tmp_path / "null")
    B.write_blocked(spark.range(0).withColumn("block_id", F.lit(1)), empty)
    write_manifest(spark, empty)
    assert stored_inventory(spark, empty).count() == 0 and manifest_changes(spark, empty).count() == 0
    spark.range(3).withColumn("block_id", F.when(F.col("id") > 0, 5)).write.partitionBy("block_id").parquet(null)
    write_manifest(spark, null)
    assert sorted(map(str, stored_inventory(spark, null).collect())) == sorted(
        map(str, B.block_inventory(read_blocked(spark, null)).collect()))


def test_plan_table_prunes_the_scan(spark, table):
    plan = spark.createDataFrame([(2, [0, 5]), (1, [3])], "size INT, block_ids ARRAY<INT>")
    whole = read_blocked(spark, table)
    got = B.blocks_by_plan(whole, plan, [1, 2])
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", _plan(got))
    want = [(2, r.id) for r in B.blocks_by_ids(whole, [0, 5]).collect()] + [(1, r.id) for r in B.blocks_by_ids(whole, [3]).collect()]
    assert sorted((r["size"], r["id"]) for r in got.collect()) == sorted(want)
