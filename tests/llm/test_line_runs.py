"""Operator 12 against a dictionary version, over batch counts and odd inputs."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_runs as L

from .conftest import ODD

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            k = line.strip(BLANK).translate(LOW)
            if len(k) >= 20 and i is not None:
                held[k].add(i)
    top = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or top.get(x.strip(BLANK).translate(LOW), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = ["The same long line, shared by many", " the SAME long line, shared by many\r", "ÉTÉ comme hiver, une longue ligne", "été comme hiver, une longue ligne",
         "exactly twenty chars", "nineteen characters", "日本語" * 7, "", "only here and there, in two of them"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, "\n".join(LINES[(i * j) % len(LINES)] for j in range(i % 7))) for i in range(60)]
    out += [(5, LINES[8]), (5, LINES[8]), (6, LINES[8]), (None, LINES[0] + "\n" + LINES[0]), (100, LINES[0] + "\n\n" + LINES[0] + "\n")]
    return out + ODD


def test_against_a_dictionary(spark, rows):
    got = L.op12(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("batches", [1, 2, 3, 5, 8])
def test_batches_do_not_matter(spark, rows, batches):
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_runs(spark):
    """Repeated keys are not counted again; two runs of a level become one of the next."""
    runs = L.LineRuns(spark, min_docs=2)
    for ids in ([9, 8], [7], [6], [5]):
        batch = [("hot", i) for i in ids] + [(f"own {i}", i) for i in ids]
        runs.add(spark.createDataFrame(batch, "key string, doc_id long").select(F.encode("key", "utf-8").alias("key"), "doc_id"))
    assert {level: len(t) for level, t in runs.levels.items() if t} == {2: 1}
    merged = {bytes(r.key).decode(): (r.n_docs, r.top) for r in runs.runs()[0].collect()}
    assert merged["hot"] == (2, 9) and merged["own 5"] == (1, 5) and len(merged) == 6
    assert [(bytes(r.key), r.top) for r in runs.repeated().collect()] == [(b"hot", 9)]
    runs.close()
    assert not spark.catalog.databaseExists(runs.name)


def test_runs_meet_without_a_shuffle(spark):
    runs = L.LineRuns(spark)
    for i in (2, 1):
        runs._write(spark.createDataFrame([(b"k", 1, i)], "key binary, n_docs long, top long"), 0)
    plan = runs._merged(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_odd_tables(spark, docs_of):
    odd = docs_of(ODD).selectExpr("*", "1 as key", "2 as top", "3 as n_lines", "4 as batch")
    assert L.op12(odd).count() == len(ODD)
    assert L.op12(odd.limit(0)).collect() == []
    assert {r.n_dropped for r in L.op12(docs_of([(None, "a line of twenty chars or more")] * 5)).collect()} == {0}
