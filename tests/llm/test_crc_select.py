"""Operator 11 against zlib, a dictionary version and odd inputs."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import crc_select as C

from .conftest import ODD

TABLE = C.PositionTable()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.data())
def test_spans_of_any_length(data, draw):
    spans = draw.draw(st.lists(st.tuples(st.integers(0, len(data) - 1), st.integers(1, len(data))), min_size=1, max_size=20))
    s = np.array([a for a, _ in spans])
    e = np.minimum(s + np.array([n for _, n in spans]), len(data))
    got = TABLE.crc(np.frombuffer(data, np.uint8), s, e)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(s, e, strict=True)]


@pytest.mark.parametrize("n", [63, 64, 65, 127, 128, 129, 4096, 1_000_003])
def test_blocks(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    assert TABLE.crc(data, np.array([0]), np.array([n])).tolist() == [zlib.crc32(data.tobytes())]


def brute(docs, bench, percent=5):
    low = str.maketrans(C.__dict__.get("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "abcdefghijklmnopqrstuvwxyz")

    def feats(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return ws, [" ".join(ws[i:i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s, t = (Counter(bucket(f) for _, text in rows for f in feats(text)[1]) for rows in (docs, bench))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        ws, fs = feats(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(ws)])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], -r[2], r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=repr)


def test_against_a_dictionary(spark):
    rng = np.random.default_rng(5)
    vocab = ["alpha", "Beta", "ga-mma", "délta", "日本語", "x9", "y" * 90, "no.one"]
    docs = [(int(i), " ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in range(300)] + ODD + [(7, "again " * 30), (7, "again " * 30)]
    bench = [(1, "alpha beta x9"), (2, None), (3, "日本語 délta " * 9)]
    got = C.op11(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                 spark.createDataFrame(bench, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(docs, bench)


def test_ties_and_all_drawn(spark):
    """Equal rows tie in everything: each takes a rank of its own; at 100 per cent all are drawn."""
    docs = [(3, "w " * 25)] * 4 + [(None, "w " * 25), (2, "short")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = C.select(d, d, percent=100).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4, 5]
    assert [r["rank"] for r in rows if r.doc_id == 2] == [None]


def test_odd_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "one same row")], "item_id long, text string")
    odd = docs_of(ODD).selectExpr("*", "1 as rank", "2 as weight", "3 as n_words")
    assert C.op11(odd, bench).count() == len(ODD)
    assert C.op11(odd.limit(0), bench).collect() == []
    empty = C.op11(odd, bench.limit(0)).collect()
    assert len(empty) == len(ODD) and all(r.weight == 0 for r in empty if r.n_features == 0)


def test_kth_highest(spark):
    rng = np.random.default_rng(1)
    vals = [int(x) for x in rng.integers(-10**12, 10**12, 3000)] + [5] * 50
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    for k in (1, 700, 1520, 3050):
        assert C.lowest_of_top(df, "v", k, bins=64) == sorted(vals, reverse=True)[k - 1]
    assert C.lowest_of_top(df, "v", 0) is None
