"""Periodic runs, source divergence and passage attention, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinthwork.llm import attention, divergence, periods, queries
from tests.llm.test_copies import frame
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


# Periodic runs


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    out = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in out]


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_brute_force(seed):
    r = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(r.randint(1, 6)):
            kinds = r.choice([0, 1, 2, 20])
            words = [b"%d" % r.randint(0, kinds) for _ in range(r.randint(0, 60))]
            texts.append(words + (words[: r.randint(1, 9)] * 9)[: r.randint(0, 40)])
        least, pairs = r.choice([12, 12, 4, 2]), r.choice([1 << 19, 7, 50])
        for words, got in zip(texts, periods.runs_of(texts, least, pairs)):
            assert [tuple(x) for x in got.tolist()] == plain_runs(words, least)


def test_nested_and_adjacent_runs():
    """A long period over short ones, Fibonacci words, and runs that overlap by less than a period."""
    a, b = ["b"], ["a"]
    for _ in range(11):
        a, b = b, b + a
    block = ["x"] * 13 + ["y", "z"]
    for words in (b, block * 4, ["p", "q"] * 7 + ["q", "r"] * 7, ["w"] * 5000):
        got = periods.runs_of([words])[0]
        assert [tuple(x) for x in got.tolist()] == plain_runs(words)
        assert periods.collapsed_words(words, got) == plain_collapse(words, plain_runs(words))


def test_periodic_runs_of_a_table(spark):
    rows = [(1, "a b " * 9), (2, None), (3, ""), (4, " \t\x0b\n"), (5, "one"), (1, "a b " * 9), (None, "c " * 20), (6, "  x  " * 12), (7, " ".join(["u", "v", "w"] * 70_000))]
    got = periods.periodic_runs(frame(spark, rows).withColumn("runs", F.lit(9)).withColumn("__body", F.lit("x")).drop("runs")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    want = {i: (plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t) for i, t in rows if i != 7}
    for r in got:
        if r.doc_id == 7:
            assert [tuple(x) for x in r.runs] == [(0, 210_000, 3)] and r.collapsed == "u v w"
        else:
            runs, text = want[r.doc_id]
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == " ".join(plain_collapse(words, runs))
    assert periods.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_planted_periods_follow_the_rule(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 31}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (10**15, None)]
    got = {r.doc_id: r.text for r in periods.with_repeats(frame(spark, rows)).collect()}
    turned = 0
    for i, t in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            t, turned = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n)), turned + 1
        assert got[i] == t
    assert turned > 10


def test_periods_query(spark):
    """Every row of the digest, from plain code."""
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 9000").fetchall()
    got = {r.doc_id: r for r in queries.op13_periods(spark, SF).collect()}
    assert len(got) == 200
    for i, t in texts:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert tuple(got[i]) == (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest())


# Source divergence


def plain_audit(rows, least_docs, top):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counter(word.findall((text or "").translate(lower)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        have = Counter(t for a, _, c in docs if a == lang for t in c)
        kept = [t for t, n in have.items() if n >= least_docs]

        def shares(match):
            n = Counter()
            for a, s, c in docs:
                if a == lang and match(s):
                    n.update({t: c[t] for t in kept if t in c})
            total = sum(n.values()) + 5 * len(kept)
            return n, {t: 1 + int(Fraction(10**9 * (n[t] + 5), total)) for t in kept}

        whole = shares(lambda s: True)[1]
        each = {s: shares(lambda x, s=s: x == s) for s in {d[1] for d in docs if d[0] == lang}}
        for s, (n, p) in each.items():
            pairs = sorted((-sum(abs(p[t] - q[t]) for t in kept), o) for o, (_, q) in each.items() if o != s)
            terms = sorted((whole[t] - p[t], t.encode()) for t in kept if n[t] and p[t] > whole[t])[:top]
            out += [(lang, s, "pair", o, -f, k + 1) for k, (f, o) in enumerate(pairs)] + [(lang, s, "term", t.decode(), -f, k + 1) for k, (f, t) in enumerate(terms)]
    return sorted(out)


def test_divergence_query_matches_sql(spark):
    assert not compare(spark, connect(SF), queries.op11_divergence, divergence.SQL, SF)


def test_divergence_with_nulls_ties_and_many_sources(spark):
    """Over one tile of sources, tied terms with long common beginnings, and groups without terms."""
    r = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "日本", "x" * 40 + "a", "x" * 40 + "b", "x" * 40, "d'or", "a1b"]
    rows = [("en", f"s{r.randint(0, 150)}", " ".join(r.choices(words, k=r.randint(0, 6)))) for _ in range(400)]
    rows += [(None, None, None), (None, "s1", "beta"), ("", "s2", "beta beta"), ("fr", "only", "mot"), ("de", "s1", "123 !"), ("de", "s2", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit(1), "term": F.lit("x")}).repartition(5)
    got = sorted(map(tuple, divergence.audit(docs, least_docs=2, top=4).collect()))
    assert got == plain_audit(rows, 2, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_radix_select_against_sorting(spark):
    r = random.Random(5)
    rows = [(r.choice("aab"), r.choice([1, 2, 3, 1 << 29, (1 << 29) + 1, r.randint(1, 1 << 29)]), f"{'p' * r.choice([0, 3, 9, 17, 40])}{i}".encode()) for i in range(600)] + [("c", 5, b"z"), ("c", 5, b"")]
    data = spark.createDataFrame(rows, "g string, v bigint, t binary")
    for k in (1, 7, 50, 900):
        got = sorted((x.g, x.v, bytes(x.t)) for x in divergence.largest(data, ("g",), "v", "t", k).collect())
        assert got == sorted(x for g in "abc" for x in sorted((y for y in rows if y[0] == g), key=lambda y: (-y[1], y[2]))[:k])


# Attention


def test_passages_are_encoded_alike_alone_and_together():
    r = random.Random(2)
    texts = ["", " \n", "One two THREE!!", "mot " * 47, "a$ b% c& " * 40, " é日 " * 200, *(" ".join("abc|!9Z"[r.randint(0, 6)] * r.randint(1, 9) for _ in range(r.randint(0, 300))) for _ in range(20))]
    together, bags = attention.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert bags.tolist() == [max(1, -(-len(t.encode().split()) // 48)) for t in texts]
    alone = [attention.encode(pa.array([t.encode()], pa.binary()))[0] for t in texts]
    assert np.allclose(together, np.concatenate(alone))
    whole, attention._CHUNK = attention._CHUNK, 100
    try:
        assert np.allclose(together, attention.encode(pa.array([t.encode() for t in texts], pa.binary()))[0])
    finally:
        attention._CHUNK = whole
    low, high = together[2][:2]
    assert (low, high) == (np.float32(5 / 13), np.float32(6 / 13)) and together[0].sum() == 0
    sliced = pa.array([b"x y", *(t.encode() for t in texts)], pa.binary()).slice(1)
    assert np.allclose(together, attention.encode(sliced)[0])


def test_gradients_are_those_of_finite_differences():
    dice = np.random.default_rng(0)
    bags, y = np.array([1, 3, 2, 5]), np.array([0.0, 1, 1, 0])
    x, n = dice.normal(size=(11, attention.FEATURES)), np.array([1.0, 2, 1, 3])
    model = attention.plain()
    model.weights = [dice.normal(0, 0.3, w.shape) for w in model.weights]

    def loss():
        p = 1 / (1 + np.exp(-model._forward(x, bags)[-1]))
        return -(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / n.sum()

    for w, g in zip(model.weights, model.gradients(x, bags, y, n)):
        for at in [tuple(dice.integers(0, s) for s in w.shape) for _ in range(5)]:
            kept, d = w[at], 1e-5
            w[at] = kept + d
            up = loss()
            w[at] = kept - d
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * d) - g[at]) < 1e-6


def test_attention_finds_the_one_bad_passage():
    """Bags differ in one passage only; attention on it is far above the share of the others."""
    dice = np.random.default_rng(4)
    bags = np.full(200, 20)
    x = dice.normal(0, 0.3, (4000, attention.FEATURES))
    y = np.arange(200) % 2.0
    bad = np.arange(200) * 20 + dice.integers(0, 20, 200)
    x[bad[y == 0], 3] += 4
    model = attention.learn(x[:3000], bags[:150], y[:150])
    assert ((model.scores(x[3000:], bags[150:]) >= 0.5) == (y[150:] == 1)).mean() >= 0.95
    weight = model._forward((x - model.mean) / model.scale, bags)[3]
    assert np.median(weight[bad[y == 0]]) > 4 / 20


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality(spark, sf).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    print(f"{sum(right)} of {len(right)} held-out labels are right")
    assert np.mean(right) >= 0.97


def test_quality_with_nulls_repeats_and_without_labels(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "x " * 100_000), (1, None), (None, "word"), (4, "word")]).withColumn("score", F.lit("clash")).withColumn("y", F.lit(3))
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 0), (None, 1)], "doc_id long, quality int")
    model = attention.fit(docs, labels)
    got = attention.score_documents(docs, model).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    assert {r.doc_id: r.held_out for r in got}[None] is True
    assert attention.score_documents(docs.limit(0), model).count() == 0
    assert attention.fit(docs.limit(0), labels.limit(0)).scores(np.zeros((1, attention.FEATURES)), np.array([1])) == 0.5
