"""Operators against brute-force versions and planted cases on small fixtures."""
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import (bt_rank, components, decontam, kernel as K, ngram_join, pii_crf, pst, quality_ngram, quote_link,
                         soft_mix, toxicity_fm, url_filter)
from tessera.llm.linear import platt, sigmoid

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", " ", "a", "A b", "one two three four", "One two\tthree four five", "x y z x y z x y z x y z", "é ü\nß é",
         "same line\nsame line\n\nother\nsame line", "p" * 50 + " q", "a b c d e f a b c d e g # $ <>"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def some_texts(n, seed, vocabulary=300, size=(20, 60)):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(v) for _ in range(rng.randint(*size))) for _ in range(n)], rng, v


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_kernel(limit):
    col = pa.array([*TEXTS, None])
    seen, sets = [], []
    by_hash: dict = {}
    for lo, hi, data, offs in K.chunks(col, limit):
        h, d, s, e = K.words(data, offs)
        raw = bytes(data)
        got = [[] for _ in range(hi - lo)]
        for x, i, a, b in zip(h.tolist(), d, s, e, strict=True):
            w = raw[a:b].decode().translate(LOWER)
            got[i].append(w)
            assert by_hash.setdefault(x, w) == w
        seen += got
        dd, w = K.shingles(data, offs)
        sets += np.bincount(dd, minlength=hi - lo).tolist()
    assert seen == [words(t) for t in [*TEXTS, ""]]
    assert len(set(by_hash.values())) == len(by_hash)
    assert sets == [len(shingle_set(t)) for t in [*TEXTS, ""]]


def test_quality_counts():
    for lo, hi, data, offs in K.chunks(pa.array(TEXTS)):
        got = quality_ngram.counts(data, offs)
        for i, t in enumerate(TEXTS):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            grams = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
            hit = {j + k for j in range(len(w) - 4) if grams[tuple(w[j:j + 5])] > 1 for k in range(5)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
                    "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
            assert {k: int(v[i]) for k, v in got.items()} == want


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def near_copies():
    texts, rng, v = some_texts(30, 3)
    rows = list(texts)
    for t in texts[:12]:  # copies with 0 to 4 changed words, copies of copies
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(v) + "x"
            t2 = " ".join(w)
            rows.append(t2 if rng.random() < 0.6 else t2.upper())
            if rng.random() < 0.4:
                t = t2
    rows += ["short text", "Short  text", "a b c d", "", "   "]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("percent", [80, 60])
def test_ngram_join(spark, docs_of, percent):
    rows = near_copies()
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(rows)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_join.classes(docs_of(rows), ngram_join.Params(percent=percent)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_decontamination(spark, docs_of):
    texts, rng, v = some_texts(40, 5)
    items = [" ".join(rng.choice(v) for _ in range(n)) for n in (6, 11, 12, 15, 25, 40, 3)]
    rows = list(texts)
    for it in items:
        for changes in (0, 1, 2, 5):
            w = it.split()
            for j in rng.sample(range(len(w)), min(changes, len(w))):
                w[j] = "zzz"
            rows.append(f"{rng.choice(texts)} {' '.join(w).upper()}! {rng.choice(texts)}")
    rows = list(enumerate(rows))
    p = decontam.Params()
    norm = lambda t: re.findall(r"[a-z0-9]+", t.lower())

    def hit(doc, item):
        d, m = norm(doc), norm(item)
        n = min(len(m), p.window)
        for g in range(-len(m) + 1, len(d)):
            if len(m) < p.span:
                if p.min_words <= len(m) and 0 <= g <= len(d) - len(m) and d[g:g + len(m)] == m:
                    return True
                continue
            lo, hi = max(0, -g), min(len(m), len(d) - g)
            same = [m[j] == d[g + j] for j in range(lo, hi)]
            seed = any(all(same[a + j] for j, c in enumerate(mask) if c == "1")
                       for mask in p.masks for a in range(len(same) - p.span + 1))
            if seed and any(100 * sum(same[a:a + n]) >= p.percent * n for a in range(len(same) - n + 1)):
                return True
        return False

    want = {(i, j) for i, t in rows for j, it in enumerate(items) if hit(t, it)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.op2(docs_of(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 12


def test_decontamination_without_seed_condition(spark, docs_of):
    """Every pattern of changed words that the 80 per cent rule accepts is found,
    and each item alone in its documents; one change more hides it."""
    p = decontam.Params()
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in range(5, 16)} | {40: [f"i40w{j}" for j in range(40)]}
    rows, want = [], set()
    for n, item in items.items():
        wrong = min(n, 15) - math.ceil(min(n, 15) * 0.8)
        patterns = [c for k in (wrong, wrong + 1) for c in itertools.combinations(range(n), k)] if n < 16 else []
        patterns += [tuple(range(a, n, 5)) for a in range(5)] if n > 15 else []
        if n == 15:
            patterns = patterns[:455] + patterns[455::50]
        for c in patterns:
            w = [f"x{len(rows)}y{j}" if j in c else x for j, x in enumerate(item)]
            rows.append((len(rows), "before it " + " ".join(w) + " after it"))
            if len(c) <= wrong or n > 15:
                want.add((rows[-1][0], n))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.op2(docs_of(rows), bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 800
    assert all(decontam.least_hits(n, p) > 0 for n in range(5, 60))


def test_machine_learns_a_pair():
    """Either term is toxic, both together are not: no additive weights can say so."""
    rng = random.Random(2)
    texts, y = [], []
    for _ in range(2600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["w" + str(rng.randrange(30)) for _ in range(4)] + ["insult"] * a + ["group"] * b))
        y.append(float(a != b))
    m = toxicity_fm.fit(pa.array(texts[:2000]), np.array(y[:2000]))
    for _, hi, data, offs in K.chunks(pa.array(texts[2000:])):
        s = m.score(*toxicity_fm.terms(data, offs), hi)
    assert ((s > 0.5) == (np.array(y[2000:]) > 0)).mean() > 0.98


def rare_pair(rows: int, share: float, seed: int):
    """Texts of 12 words; an insult or a group word, each in ``share`` of the rows, is toxic unless
    the other one is there too, in half of these rows."""
    rng = np.random.default_rng(seed)
    texts, y, both = [], [], []
    for r in rng.random(rows).tolist():
        a, b = r < share, r < share / 2 or share <= r < 1.5 * share
        words = [f"w{z % 2000}q" for z in rng.zipf(1.3, 12)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(float(a != b))
        both.append(a and b)
    return pa.array(texts), np.array(y), np.array(both)


def predicted(m, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for lo, hi, data, offs in K.chunks(texts):
        out[lo:hi] = m.score(*toxicity_fm.terms(data, offs), hi - lo) >= toxicity_fm.THRESHOLD
    return out


@pytest.mark.parametrize("share, found", [(0.05, 0.95), (0.015, 0.85), (0.005, 0.5)])
def test_machine_learns_a_rare_pair(share, found):
    """Terms in half a per cent of the sample rows still have a pair weight."""
    m = toxicity_fm.fit(*rare_pair(10_000, share, 3)[:2])
    texts, y, both = rare_pair(10_000, share, 4)
    got = predicted(m, texts)
    assert both.sum() >= 15 and (~got[both]).mean() >= 0.9
    assert got[y > 0].mean() >= found and got[y == 0].mean() < 0.005
    alone = toxicity_fm.Machine(m.terms, m.bias, m.w, m.v * 0)
    assert predicted(alone, texts)[both].mean() > 0.9     # the weights alone are wrong about the pair


def test_sample_sizes_and_fits_from_tables(spark, docs_of, monkeypatch):
    """10,000 and 3,000 labelled rows are learnt from, and as from texts in memory."""
    texts, rng, v = some_texts(10_200, 12, vocabulary=40, size=(3, 6))
    toxic = [int("a" in t.split()[0]) for t in texts]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    seen = {}

    def spied(module, at):
        def learn(*args, was=module.learn):
            seen[module] = len(args[at])
            return was(*args)
        monkeypatch.setattr(module, "learn", learn)

    spied(toxicity_fm, 4)
    spied(soft_mix, 1)
    p = toxicity_fm.Params(warm=2, stage=1)
    m = toxicity_fm.train(docs_of(rows), labels, p=p)
    assert seen[toxicity_fm] == 10_000 and m.usable
    table = spark.createDataFrame([(i, "ab"[y]) for i, y in enumerate(toxic[:3_300])], "doc_id long, domain string")
    soft_mix.train(docs_of(rows[:3_300]), table, ("a", "b"), soft_mix.Params(steps=2))
    assert seen[soft_mix] == 3_000
    some = rows[:300]
    got = toxicity_fm.train(docs_of(some), labels.filter("doc_id < 300"), p=p)
    want = toxicity_fm.fit(pa.array(texts[:300]), np.array(toxic[:300], float), p)
    assert (got.terms == want.terms).all() and got.bias == want.bias and (got.w == want.w).all() and (got.v == want.v).all()
    q = soft_mix.Params(steps=3)
    got = soft_mix.train(docs_of(some), table.filter("doc_id < 300"), ("a", "b"), q)
    want = soft_mix.fit(pa.array(texts[:300]), ["ab"[y] for y in toxic[:300]], ("a", "b"), q)
    assert np.allclose(got.weights, want.weights, atol=1e-6) and np.allclose(got.bias, want.bias)


def labelled(n=400, seed=4):
    texts, rng, _ = some_texts(n, seed, vocabulary=80)
    y = np.arange(n) % 2
    return [t if k else re.sub(" ", " ### ", t) for t, k in zip(texts, y, strict=True)], y.astype(float)


def test_quality_model_and_ranking():
    texts, y = labelled()
    model = quality_ngram.fit(pa.array(texts[:300]), y[:300], np.arange(300))
    ranker = bt_rank.fit(pa.array(texts[:300]), y[:300])
    for _, _, data, offs in K.chunks(pa.array(texts[300:])):
        assert ((model.probability(data, offs) > 0.5) == (y[300:] > 0)).mean() > 0.98
        s = ranker.score(data, offs)
        assert s[y[300:] > 0].min() > s[y[300:] == 0].max()
        # the Arrow score equals the score over explicit features
        x = model.grams.rows(pa.array(texts[300:]))
        assert np.allclose(x.dot(model.weights.astype(float)), model.grams.score(model.weights, data, offs), atol=1e-3)


def test_platt_is_calibrated():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=20_000)
    y = (rng.random(20_000) < sigmoid(1.5 * raw - 0.7)).astype(float)
    a, b = platt(raw, y)
    assert abs(a - 1.5) < 0.1 and abs(b + 0.7) < 0.1


def test_quantile(spark):
    df = spark.createDataFrame([(i, float(i % 100)) for i in range(1000)], "doc_id long, score double")
    kept = bt_rank.by_quantile(df, 0.3).filter("kept").count()
    assert kept == sum(i % 100 >= 29 for i in range(1000))


def brute_tree(texts, p):
    """P(a | tokens before) by plain counting: root, candidates, own symbols, divergence test."""
    streams = [["<s>", *words(t), None] for t in texts]
    count = Counter(tuple(s[i:j]) for s in streams for i in range(len(s)) for j in range(i + 1, min(len(s), i + p.depth + 1) + 1))
    total, once = sum(len(s) - 1 for s in streams), sum(c == 1 for g, c in count.items() if len(g) == 1 and g[0] not in ("<s>", None))
    unknown = (once + 1) / (total + 2)
    retained = {}

    def prob(a, before):
        before = tuple(before)[-p.depth:]
        if not before:
            return (1 - unknown) * count[(a,)] / total if count[(a,)] and a != "<s>" else unknown
        rest = prob(a, before[1:])
        if before not in retained:
            return rest
        own, b = retained[before]
        return (own.get(a, 0) + b * rest) / (count[before] + p.alpha)

    for d in range(1, p.depth + 1):
        level = {}
        for ctx in {g for g in count if len(g) == d and g[-1] is not None and count[g] >= p.min_context}:
            own = {g[-1]: c for g, c in count.items() if len(g) == d + 1 and g[:-1] == ctx and c >= p.min_pair}
            n, b = count[ctx], count[ctx] + p.alpha - sum(own.values())
            gain = sum(c * math.log((c + b * q) / (n + p.alpha) / q) for c, q in ((c, prob(a, ctx[1:])) for a, c in own.items()))
            gain += (n - sum(own.values())) * math.log(b / (n + p.alpha))
            if own and gain >= p.min_gain:
                level[ctx] = own, b
        retained.update(level)
    return prob, retained, {g[0] for g in count if len(g) == 1 and g[0] != "<s>"}


@pytest.mark.parametrize("hot", [1e-9, 0.01, 1.0])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree_against_brute_force(spark, docs_of, hot, depth):
    """The whole score, by another way: contexts, retained ones, smoothing, sum over the text."""
    rng = np.random.default_rng(depth)
    phrases = ["a m b", "c m d", "one two three four", "six two three nine"]    # the last word needs 2 or 3 before it
    texts = [" ".join(phrases[rng.integers(4)] if rng.random() < 0.7 else f"w{rng.integers(40)}" for _ in range(8)) for _ in range(80)]
    rows = list(enumerate([*texts, "", None, "never seen", "six two never three"]))
    p = pst.Params(hot=hot, depth=depth, min_gain=2.0)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    prob, retained, known = brute_tree([t for (i, t), h in zip(rows, held, strict=True) if not h], p)
    assert {len(s) for s in retained} == set(range(1, depth + 1))
    for ctx in [*retained, ("w1",), ("b", "w2")]:    # a distribution over the known tokens and one unknown one
        assert abs(sum(prob(a, ctx) for a in known) + prob("<unk>", ctx) - 1) < 1e-9
    got = {r.doc_id: r.score for r in pst.op6(docs_of(rows), p).collect()}
    for i, t in rows:
        s = ["<s>", *words(t), None]
        assert abs(got[i] - sum(math.log10(prob(s[j], s[:j])) for j in range(1, len(s)))) < 1e-6


def test_suffix_tree_grows_with_the_corpus(docs_of):
    """Twice as many texts of as many new words: twice the nodes, whatever the share of each."""
    def nodes(parts):
        rows = [(p * 100 + i, " ".join(f"{w}{p}" for w in "a b c a d e a b c".split())) for p in range(parts) for i in range(20)]
        return pst.train(docs_of(rows))[0].filter("words = 0").count()
    small, large = nodes(4), nodes(8)
    assert small > 4 and large >= 2 * small - 2


def test_context_decides_the_score(docs_of):
    """Held-out texts in a known order beat the same words shuffled, and the base score."""
    held = next(i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    other = next(i for i in range(held + 1, held + 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "the old man and the sea are far from the new town") for i in range(60)]
    rows += [(i, f"x{i} y{i} the town") for i in range(60, 120)]
    rows += [(held, rows[0][1]), (other, " ".join(sorted(rows[0][1].split())))]
    got = {r.doc_id: r for r in pst.op6(docs_of(rows)).collect()}
    assert got[held].score > got[other].score + 3 and got[held].score > got[held].base_score + 3
    assert abs(got[held].base_score - got[other].base_score) < 1e-9


def test_suffix_tree_leaves_no_shuffle_files(spark, docs_of):
    """Each level's shuffle goes with its query, and the tree with the scores: the disk holds one at a time."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def files():
        return {f for f in (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))
                if f.startswith("shuffle_")}
    names = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, kept = files(), [spark.conf.get(x) for x in names]
    rows = [(i, "the old man and the sea are far from the new town") for i in range(60)]
    assert len(pst.op6(docs_of(rows)).collect()) == 60
    for _ in range(50):     # files go in the background
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left
    assert [spark.conf.get(x) for x in names] == kept


def test_packed_counts(docs_of):
    """Rows that meet from many small sendings; every key in its bucket."""
    texts, _, _ = some_texts(60, 8, vocabulary=40)
    df = docs_of(list(enumerate([*texts, "", None, texts[0]])))
    want = Counter(w for t in [*texts, texts[0]] for w in words(t))
    for n, limit in ((1, 1 << 19), (8, 10), (300, 100)):
        of = lambda data, offs: [K.words(data, offs)[0]]
        got = [r.c for r in pst.counted(df, of, n, False, 2, limit).collect()]
        assert sorted(got) == sorted(c for c in want.values() if c >= 2)
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64, endpoint=False))
    assert (pst.unsteps(pst.steps(keys)) == keys).all()
    asked = np.concatenate([keys, keys + K.U64(1), np.array([0, 2**64 - 1], K.U64)])
    for table in (keys, keys[:1], keys[:0]):
        i, hit = pst.Sorted(table).find(asked)
        assert (hit == np.isin(asked, table)).all() and (table[i[hit]] == asked[hit]).all()


def test_parts_of_any_size_give_the_same_scores(spark, docs_of):
    texts, _, _ = some_texts(60, 8, vocabulary=40)
    df = docs_of([(None if i % 9 == 4 else i % 50, t) for i, t in enumerate([*texts, "", None, texts[0], texts[0]])]).select("doc_id", "text")
    p = pst.Params(hot=0.05)
    tree, t = pst.train(df, p)
    one, many = (sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, round(r.base, 8), round(r.score, 8)) for r in
                        pst.score(df.repartition(k, "text"), tree, t, p, limit).collect() if r.doc_id is not None)
                 for k, limit in ((1, 1 << 20), (3, 5)))
    assert one == many and len(one) == sum(i % 9 != 4 for i in range(len(texts) + 4))


@pytest.mark.parametrize("hot", [1e-9, 0.02, 1.0])
def test_lm_scores(spark, docs_of, hot):
    texts, _, _ = some_texts(60, 8, vocabulary=40)
    rows = list(enumerate([*texts, "", None, texts[0]]))
    p = pst.Params(hot=hot)
    got = {r.doc_id: r for r in (pst.op6(docs_of(rows), p)).collect()}
    other = {r.doc_id: r for r in (pst.op6(docs_of(rows), pst.Params(hot=0.1))).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    seen = Counter(w for i, t in rows if not held[i] for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    for i, t in rows:
        ws = [*words(t), None]
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(seen[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - other[i].score) < 1e-6
        assert r.score < 0


PII = ["mail a.b+c@x-y.co.uk, and a@b @c.d x@y.z@w.v", "10.0.0.1 1.2.3.4.5.6.7.8 300.1.1.1 1.2.3",
       "card 4111 1111 1111 1111 or 4111-1111-1111-1112 0", "+1 (487) 555-7209 é +44.20.7946.0958x +12", "", "9" * 40]


def test_patterns():
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = random.Random(5)
    more = ["".join(rng.choice("a1@.+-0 9().") for _ in range(60)) for _ in range(400)]
    for t in PII + more:
        want = []
        for k, pat in enumerate(pats):
            for m in re.finditer(pat, t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                      14 <= len(digits) <= 19 and pii_crf.luhn(digits), 10 <= len(digits) <= 15][k]
                if ok:
                    want.append((m.start(), m.end(), k))
        assert pii_crf.pattern_spans(t) == sorted(want, key=lambda x: (x[0], x[2])), t


def test_viterbi_and_gradient():
    """Decoding equals the best of all label paths; the field learns its table."""
    rng = np.random.default_rng(1)
    sizes = [1, 3, 2, 4]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = int(bounds[-1])
    w = pii_crf.Words(np.zeros(n, int), np.arange(n), np.arange(n) + 1, rng.integers(0, 32, (n, pii_crf.N_FEATURES)), bounds)
    f = pii_crf.Field(rng.normal(size=(32, pii_crf.LABELS)), rng.normal(size=(pii_crf.LABELS, pii_crf.LABELS)))
    got = f.decode(w)
    emit = f.emit[w.ids].sum(axis=1)
    for a, b in zip(bounds, bounds[1:], strict=False):
        def value(path, a=a):
            ok = pii_crf.START[path[0]] and all(pii_crf.ALLOWED[x, y] for x, y in zip(path, path[1:], strict=False))
            return (sum(emit[a + i, x] for i, x in enumerate(path)) + sum(f.step[x, y] for x, y in zip(path, path[1:], strict=False))
                    if ok else -1e18)
        best = max(itertools.product(range(pii_crf.LABELS), repeat=min(b - a, 3)), key=value) if b - a <= 3 else None
        assert best is None or list(best) == got[a:b].tolist()


def test_field_adds_spans(spark, docs_of):
    rng = random.Random(6)
    rows = [(i, f"word é call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} now. id {rng.randrange(10**6)}") for i in range(80)]
    rows += [(500, "é ring (487) 555-7209 today"), (501, "year 2020 and 17 apples"), (502, "a 10.0.0.1 b")]
    out = {r.doc_id: r for r in pii_crf.op10(docs_of(rows)).collect()}
    assert out[500].n_phone == 0 and out[500].spans == "phone:7:21"
    assert out[501].spans == "" and out[502].spans == "ip:2:10" and out[502].n_ip == 1
    assert out[502].base_sha256 == hashlib.sha256(b"ip:2:10").hexdigest()
    field = pii_crf.train(docs_of(rows).select("text"))
    clean = {r.doc_id: r.redacted for r in pii_crf.detect(docs_of(rows), field, redact=True).collect()}
    assert clean[500] == "é ring <PHONE> today" and clean[501] == "year 2020 and 17 apples"


def test_mask_merges_overlaps():
    assert pii_crf.mask("abcdefgh", [(1, 4, 2), (3, 6, 3), (7, 8, 0)]) == "a<CARD>g<EMAIL>"


def test_rates_reach_targets(spark):
    rng = np.random.default_rng(3)
    post = rng.dirichlet([0.3] * 3, 500)
    rows = [(i, int(t), list(map(float, q))) for i, (t, q) in enumerate(zip(rng.integers(0, 50, 500), post, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    want = {"a": 0.1, "b": 0.3, "c": 0.6}
    m = soft_mix.rates(df, want, ("a", "b", "c"))
    out = m.rows.toPandas()
    q = np.array(out.posterior.tolist())
    share = (out.tokens.to_numpy()[:, None] * q * out.rate.to_numpy()[:, None]).sum(axis=0) / out.tokens.sum()
    assert np.abs(share - [0.1, 0.3, 0.6]).max() < 2e-4 and out.rate.min() >= 0
    assert all(abs(m.shares[k] - s) < 1e-6 for k, s in zip("abc", share, strict=True))
    # the same steps in numpy
    t, r, y, theta = out.tokens.to_numpy(), np.ones(500), np.ones(500), 1.0
    size = 1 / np.linalg.eigvalsh((q * (t / t.sum())[:, None]).T @ q)[-1]
    for _ in m.moves:
        g = (t[:, None] * q * y[:, None]).sum(axis=0) / t.sum() - [0.1, 0.3, 0.6]
        new = np.maximum(0, y - size * (q @ g))
        theta2 = (1 + math.sqrt(1 + 4 * theta**2)) / 2
        y, r, theta = new + (theta - 1) / theta2 * (new - r), new, theta2
    assert np.abs(r - out.rate).max() < 1e-6 and np.abs(soft_mix.replay(q, m.moves) - out.rate).max() < 1e-6


def test_domains_are_learnt():
    a, _, _ = some_texts(60, 1)
    b = [t.translate(str.maketrans("abcdefghij", "qrstuvwxyz")) for t in a]
    m = soft_mix.fit(pa.array(a[:40] + b[:40]), ["a"] * 40 + ["b"] * 40, ("a", "b"))
    for _, _, data, offs in K.chunks(pa.array(a[40:] + b[40:])):
        assert (m.posterior(data, offs).argmax(axis=1) == [0] * 20 + [1] * 20).all()


def test_alias_verdicts(spark):
    canon = "<head><link href='{}' rel=\"canonical\"></head>"
    rows = [(1, "http://x.org/a", canon.format("http://bad.net/es/1")),  # alias of a blocked url
            (2, "https://y.org/b?q=1#f", "<META http-equiv=refresh content='0; URL=http://x.org/a'>"),  # alias of an alias
            (3, "http://z.org/", "<meta http-equiv='refresh' content='0;url=//y.org/b?q=1'>"),
            (4, "http://ok.org/1", canon.format("/2")), (5, "http://ok.org/2", None),
            (6, "http://mixed.org/1", canon.format("http://bad.net/fr/2")),
            (7, "http://mixed.org/2", canon.format("http://mixed.org/1")),
            (8, "http://good.com/p", canon.format("http://mixed.org/2")),  # an explicit allow in the component
            (9, "http://w.net/es/q", canon.format("http://good.com/p")),  # its own rule precedes
            (10, "http://lone.org/dir/x", canon.format("y?a=1&amp;b=2")), (11, "http://lone.org/dir/y?a=1&b=2", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.via) for r in url_filter.op1(spark, pages).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "default"),
                   5: ("allow", "default"), 6: ("allow", "alias"), 7: ("allow", "alias"), 8: ("allow", "rule"),
                   9: ("block", "rule"), 10: ("allow", "default"), 11: ("allow", "default")}
    more = spark.createDataFrame([("http://lone.org/dir/x", "http://bad.net/es/1"), (None, "http://a.b/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.filter_pages(pages, url_filter.rule_table(spark, url_filter.RULES), more).collect()}
    assert got[10] == got[11] == "block" and got[4] == "allow"
    import duckdb

    from tessera.llm.queries import SQL
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    want = {r[0]: (r[4], r[5]) for r in con.execute(SQL["op1_redirect_equivalence"]).fetchall()}
    assert want == {r.page_id: (r.verdict, r.via) for r in url_filter.op1(spark, pages).collect()}


def test_quotes(spark):
    first = "Hello there, this is the first message.\nIt has a second line of some length."
    rows = [(1, 0, "a", first), (1, 1, "b", "On Monday a wrote:\n> hello  there, this is the first message.\n> It has a second line of some length.\nI agree."),
            (1, 2, "a", ">> Hello there, this is the first message.\n>> It has a second line of some length.\n> I agree.\nGood."),
            (2, 0, "c", "> It has a second line of some length.\nFrom another place."),
            (3, 0, "d", "> From another place.\nOn it goes."), (4, 0, "e", "> nowhere to be found at all\nplain"), (5, 0, "f", "no quotes")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quote_link.op5(m).collect()}
    assert got[1, 0].body == first and got[1, 1].body == "I agree." and got[1, 2].body == "Good."
    assert (got[1, 1].reply_conv, got[1, 1].reply_turn, got[1, 1].n_linked) == (1, 0, 1)
    assert (got[1, 2].reply_conv, got[1, 2].reply_turn) == (1, 1)
    assert (got[1, 2].n_passages, got[1, 2].max_level, got[1, 2].n_linked) == (2, 2, 2)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn, got[2, 0].thread, got[2, 0].level) == (1, 0, 1, 1)
    assert (got[3, 0].reply_conv, got[3, 0].thread, got[3, 0].level) == (2, 1, 2)
    assert (got[4, 0].n_linked, got[4, 0].thread, got[4, 0].reply_conv) == (0, 4, None)
    assert got[5, 0].body == "no quotes" and got[5, 0].n_passages == 0


def test_quotes_of_parts(spark):
    """Short lines, edited lines and re-wrapped paragraphs."""
    long = ["The first paragraph has a number of words.", "The second one is a little longer than the first.", "The third ends it."]
    rows = [(1, 0, "Yes, at noon.\nBring the papers along with you."), (1, 1, "> Yes, at noon.\nFine."),  # a short line
            (2, 0, "Something unrelated to all others here."), (2, 1, "one short\ntwo short\nthis line is the longest one of them\nend"),
            (2, 2, "> one short\n> two short\n> this line is the longest one, but edited by the reply\nOk."),
            (3, 0, "\n\n".join(long)),
            (3, 1, "> The second one is a little\n> longer than the first.\n>\n> The third\n> ends it.\nRe-wrapped."),
            (4, 0, "> The first paragraph has a\n> number of words.\n>\n> The second one is a little longer\n> than the first.\nElsewhere."),
            (5, 0, "shared first line of two messages\nalpha line\nbeta line"),
            (5, 1, "shared first line of two messages\ngamma line\ndelta line"),
            (5, 2, "> shared first line of two messages\n> gamma line\n> delta line\n> and an added one\nMost of them."),
            (6, 0, "> Fine\n> Yes, at noon.\n> end\nShort lines say nothing of other conversations."),
            (7, 0, "start\n \nsecond line\nwrapped here\n\nthird"), (7, 1, "> begin\n>\n> second line wrapped here\nBack in one line.")]
    m = spark.createDataFrame([(c, t, "r", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quote_link.op5(m).collect()}
    want = {(1, 1): (1, 0), (2, 2): (2, 1), (3, 1): (3, 0), (4, 0): (3, 0), (5, 2): (5, 1), (7, 1): (7, 0)}
    assert got == {(c, t): want.get((c, t), (None, None)) for c, t, _ in rows}
