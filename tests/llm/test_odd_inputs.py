"""Every operator and stage on nulls, empty and very long texts, repeated rows,
clashing extra columns and empty tables."""
import pytest

from tessera.llm import (bt_rank, decontam, ngram_join, pii_crf, pst, quality_ngram, quote_link, soft_mix, toxicity_fm,
                         url_filter)

from .conftest import ODD

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, "clash"), (4, 1, 0, "clash"), (6, 0, 1, "clash"), (None, 1, 1, None),
                                  (7, None, None, None), (8, 0, 1, "")], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word " * 20, 3), (1, "word " * 20, 3), (2, None, 3), (None, "same row same row x", 3), (3, "", 3)],
                                 "item_id long, text string, doc_id long")


PER_ROW = {
    "op3": lambda d, lab: toxicity_fm.op3(d, lab),
    "op4": lambda d, lab: quality_ngram.op4(d, lab),
    "op6": lambda d, lab: pst.op6(d),
    "op7": lambda d, lab: soft_mix.op7(d, lab),
    "op8": lambda d, lab: bt_rank.op8(d, lab),
    "op9": lambda d, lab: ngram_join.op9(d),
    "op10": lambda d, lab: pii_crf.op10(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_a_row(docs_of, labels, name):
    rows = PER_ROW[name](docs_of(ODD), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ODD)
    same = [r.asDict() for r in rows if r.doc_id == 4]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(docs_of, labels, name):
    assert PER_ROW[name](docs_of([]), labels.limit(0)).collect() == []
    assert len(PER_ROW[name](docs_of(ODD), labels.limit(0)).collect()) == len(ODD)


def test_decontamination(docs_of, bench):
    rows = decontam.op2(docs_of(ODD), bench).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(6, 1)]
    assert decontam.op2(docs_of([]), bench).collect() == []
    assert decontam.op2(docs_of(ODD), bench.limit(0)).collect() == []
    assert decontam.clean(docs_of(ODD), bench).count() == len(ODD) - 1


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.example.COM", "<link rel=canonical href=''>"),
            (None, "http://x.net/es/1", None), (4, "http://x.net/es/1", "<html>"), (4, "http://x.net/es/1", "<html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule")
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.op1(spark, pages).collect()}
    assert out == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "", None, "allow"),
                   (None, "x.net", "/es/1", "net/es/", "block"), (4, "x.net", "/es/1", "net/es/", "block")}
    assert url_filter.op1(spark, pages).count() == 6
    assert url_filter.op1(spark, pages.limit(0)).count() == 0


def test_messages(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", ""), (None, 0, "user", "> quoted\nown"), (2, None, None, ">"), (2, 0, "a", "x"),
            (2, 0, "a", "x"), (3, 0, "a", ">" * 5000), (3, 1, "a", "line\n" * 20000)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as body", "2 as level")
    out = quote_link.op5(m).collect()
    assert len(out) == len(rows)
    assert {r.body for r in out if r.conv_id is None} == {"own"}
    assert quote_link.op5(m.limit(0)).collect() == []


def test_stages(spark, docs_of, tmp_path):
    import corpus_pipeline
    docs_of(ODD).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # one row of id 4 stays, and id 6 holds the benchmark passage
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)]


def test_stages_on_empty(spark, docs_of, tmp_path):
    import corpus_pipeline
    d = docs_of([]).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(1, 1), (2, 1)], [(1, 0), (2, 1)]])
def test_toxicity_needs_both_classes(spark, docs_of, tmp_path, rows):
    """Labels that teach nothing, on non-empty documents: none goes."""
    import corpus_pipeline
    docs = docs_of([(i, f"clean text number {i}") for i in range(1, 6)])
    few = spark.createDataFrame(rows, "doc_id long, toxic int")
    few.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5]
    assert {r.predicted for r in toxicity_fm.op3(docs, few).collect()} == {0}
