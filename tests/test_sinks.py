"""Write-then-read tests for the sinks (S4, S5, S6, S8) and scans."""

from pyspark.sql import functions as F

from tessera.operators import cluster as K
import pytest

from tessera.sources import (read_centers, read_text_transactions, save_model, write_itemsets_csv,
                             write_parquet, write_text_lines)


def _itemsets(spark):
    return spark.createDataFrame([([1, 2], 5, 0.625), ([1, 3], 3, 0.375)],
                                 "items ARRAY<INT>, support BIGINT, frequency DOUBLE")


def test_parquet_overwrite(spark, tmp_path):
    p = str(tmp_path / "out.parquet")
    write_parquet(_itemsets(spark), p)
    write_parquet(_itemsets(spark), p)            # overwrite, no error
    assert spark.read.parquet(p).count() == 2


def test_csv_single_file(spark, tmp_path):
    p = tmp_path / "out.csv"
    write_itemsets_csv(_itemsets(spark), str(p))
    parts = [f for f in p.iterdir() if f.name.startswith("part-")]
    assert len(parts) == 1
    text = parts[0].read_text()
    assert "[1, 2]" in text or '"[1, 2]"' in text


def test_text_lines(spark, tmp_path):
    p = tmp_path / "lines"
    write_text_lines(_itemsets(spark), str(p))
    got = {r.value for r in spark.read.text(str(p)).collect()}
    assert got == {"{1,2}: 5", "{1,3}: 3"}


def test_text_transactions_roundtrip(spark, tmp_path):
    p = tmp_path / "tx.txt"
    p.write_text("1 2 3\n3 1\n\n7\n")
    tx = read_text_transactions(spark, str(p))
    got = sorted(tuple(r["items"]) for r in tx.collect())
    assert got == [(), (1, 2, 3), (1, 3), (7,)]


def test_centers_and_model(spark, tmp_path):
    c = spark.createDataFrame([("a", [[0.0, 0.0], [1.0, 1.0]]), ("b", [[5.0, 5.0]])],
                              "name STRING, centers ARRAY<ARRAY<DOUBLE>>")
    p = str(tmp_path / "centers.parquet")
    c.write.parquet(p)
    assert read_centers(spark, p, "a").count() == 2
    assert read_centers(spark, f"{p}:b").count() == 1
    assert read_centers(spark, f"file://{p}:b").count() == 1 == read_centers(spark, f"file://{p}", "b").count()
    for bad in (p, f"{p}:none"):     # several names and no key; no such name
        with pytest.raises(ValueError):
            read_centers(spark, bad)
    pts = spark.createDataFrame([([0.0, 0.1],), ([5.0, 5.1],), ([0.1, 0.0],)], "features ARRAY<DOUBLE>")
    model, _ = K.fit_centers(pts, 2, "kmeans", 1)
    mp = str(tmp_path / "model")
    save_model(model, mp)
    save_model(model, mp)
    from pyspark.ml.clustering import KMeansModel
    assert len(KMeansModel.load(mp).clusterCenters()) == 2
    assert pts.filter(F.size("features") == 2).count() == 3


def test_write_result(spark, tmp_path):
    from tessera.plans.fim_runs import write_result
    df = spark.createDataFrame([([1], 7, 0.875), ([1, 2], 5, 0.625), ([1, 3], 3, 0.375)],
                               "items ARRAY<INT>, support BIGINT, frequency DOUBLE")
    head = str(tmp_path / "FimOutput")
    n = write_result(df, head, 5, "sum", csv_path=str(tmp_path / "csv"))
    assert n == 2
    assert spark.read.parquet(f"{head}_5Block_sum.parquet").count() == 2
    assert spark.read.csv(str(tmp_path / "csv")).count() == 2
