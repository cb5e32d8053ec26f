"""Mended cases: same ids with other texts, names that clash, checks of added spans."""
import pytest

from tessera.llm import pii_crf, pst, quote_link, toxicity_fm

from .conftest import ODD


def test_permuted_texts_of_one_id_are_scored_apart(spark):
    """Two texts of one id with the same words in another order."""
    base = [(i, "the cat sat on the mat and the dog ran off to the sea") for i in range(1, 30)]
    pair = ["sea the to off ran dog the", "the dog ran off to the sea"]
    alone = [{r.score for r in pst.op6(spark.createDataFrame([*base, (None, t)], "doc_id long, text string")).collect()
              if r.doc_id is None} for t in pair]
    both = pst.op6(spark.createDataFrame([*base, *((None, t) for t in pair)], "doc_id long, text string")).collect()
    assert {round(r.score, 6) for r in both if r.doc_id is None} == {round(x, 6) for s in alone for x in s}


def test_links_belong_to_their_message(spark):
    rows = [(1, 0, "user", "the quick brown fox jumps over the dog"), (1, 1, "a", "> the quick brown fox jumps over the dog\nyes"),
            (1, 1, "b", "no quote at all")]
    out = quote_link.op5(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.role: (r.n_linked, r.reply_turn) for r in out} == {"user": (0, None), "a": (1, 0), "b": (0, None)}


@pytest.mark.parametrize("kind,span,ok", [(1, "1.2.3.4567", False), (1, "1.2.3.45", True), (1, "1.2.3", False), (2, "4111 1111 1111 1111", True),
                                          (2, "4111 1111 1111 1112", False), (3, "020 7946 0958", True), (3, "1" * 16, False), (0, "a@b", True)])
def test_added_spans_pass_the_checks(kind, span, ok):
    assert pii_crf.passes(kind, span) is ok


def test_predicted_follows_the_score(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for r in toxicity_fm.op3(docs_of(ODD), none).collect():
        assert r.predicted == int(r.score >= 0.3) == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P
    rows = [(i, f"a text of its own, number {i}, mail me: x{i}@mail.org please") for i in range(6)]
    rows += [(3, "the same id with another text"), (3, "the same id with another text"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *["mine"] * 8) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _id string, _bad string, _toxicity string, "
                                 "spans string, redacted string, n_ip string, base_sha256 string, component_id string")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == "mine" for r in got for c in docs.columns[5:]), name
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.doc_id != 3) == [
            *((False, i) for i in (0, 1, 2, 4, 5, 7)), (True, 0)], name
        assert sum(r.doc_id == 3 for r in got) == (2 if name == "ngram_join" else 3), name
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
