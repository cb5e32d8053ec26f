"""Operator 13 against a plain loop, with round trips and odd inputs."""
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fim_capture as M

from .conftest import ODD

TEXTS = st.text(alphabet=st.sampled_from("abZ <>PSM\n.é日😀"), max_size=60)


def brute(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexa = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexa[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), TEXTS)
def test_against_a_loop(i, text):
    assert M.rearrange(text, M.draws(1, i)) == brute(i, text)


def test_query(spark):
    rows = [(i, t) for i, t in enumerate(["a<b", "x <", "<P", "P>", "<<P>>", "ab cd\nef", "", "é" * 9, "S>M>P>", "<S<M<P"] * 30)] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = M.op13(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = []
    for i, t in rows:
        *first, out = brute(i, t)
        want.append((i, *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, t or ""))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_long_texts_stay_bounded():
    """Two million units in one match, without backtracking states."""
    text = "ab " * 1_000_000
    assert len(M.unit_ends(text)) == 2_000_000


def test_passes_columns_and_odd_tables(spark, docs_of):
    odd = docs_of(ODD).selectExpr("*", "1 as n_own", "2 as output")
    got = M.transform(odd, keep=("lang", "rep", "n", "output", "text"))
    assert got.columns == ["doc_id", "lang", "rep", "text", *M.OUT]
    assert got.filter(~(M.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit(""))))).count() == 0
    assert got.select(F.sum("rep")).first()[0] == 9 * len(ODD)
    assert M.op13(odd.limit(0)).collect() == []
