"""Findings of reviewers: rows that the small tables lack, and ways that only larger ones take."""

import itertools
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plinthwork.functions import similarity as sim
from plinthwork.operators import contracts as ct
from plinthwork.operators import linkage as lk
from plinthwork.operators import matching as m
from plinthwork.operators import scenarios as sn
from plinthwork.operators import statistics as st
from plinthwork.plans import contracts as pc
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def changed(tmp_path):
    """A copy of the smallest tables with some of them made by SQL, ``{name}`` standing for the table as it is."""

    def make(**tables):
        for f in os.listdir(SF):
            os.symlink(f"{SF}/{f}", tmp_path / f)
        for name, sql in tables.items():
            os.unlink(tmp_path / f"{name}.parquet")
            duckdb.sql(sql.format(**{name: f"'{SF}/{name}.parquet'"})).write_parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def differs(spark, name, d):
    return compare(spark, connect(d), __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], d)


def test_customers_without_orders_have_no_enforcement_signal(spark, changed):
    d = changed(orders="SELECT * FROM {orders} WHERE o_custkey % 3 <> 0")
    assert not differs(spark, "target_tiers", d)


def test_u_comes_from_all_pairs(spark):
    """Levels of all pairs, by values; the pairs of records are many more than the sample that was taken once."""
    r = random.Random(7)
    words = ["acme steel", "acme steal", "blue river", "bleu river", "cedar", "", None]
    rows = lambda n, k: [(i, r.choice(words), r.choice(["york", "yorks", "leeds", None]), r.choice(["NY", "OH", None])) for i in range(k, k + n)]
    left, right = rows(2_300, 0), rows(2_400, 10_000)
    kind = "id long, name string, city string, state string"
    sides = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    for at, c in ((1, lk.Comparison("name", "jaro_winkler", (0.95, 0.88))), (2, lk.Comparison("city", "levenshtein", (1, 2))), (3, lk.Comparison("state"))):
        want = [0] * c.levels
        for (x, n), (y, k) in itertools.product(Counter(row[at] for row in left).items(), Counter(row[at] for row in right).items()):
            if x is not None and y is not None:
                near = [sim.jaro_winkler(x, y) >= t for t in c.at] if c.kind == "jaro_winkler" else [{("york", "yorks"), ("yorks", "york")} >= {(x, y)}] * 2 if c.kind == "levenshtein" else []
                want[c.levels - 1 if x == y else sum(near)] += n * k
        assert lk.level_totals(*sides, c, tile=2) == want
        model = lk.train(*sides, (c,), (), rounds=1)
        assert model.u[c.column] == [n / sum(want) for n in want]


def test_the_grid_of_similarities_has_the_values_of_pairs():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde fé") for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 30, 62, 63, 64, 70])))
    a, b = list({word() for _ in range(80)}), list({word() for _ in range(90)})
    assert sim.jaro_winkler_grid(a, [*b, a[0]]).tolist() == [[sim.jaro_winkler(x, y) for y in [*b, a[0]]] for x in a]
    assert sim.jaro_winkler_grid([], b).shape == (0, len(b)) and sim.jaro_winkler_grid(a, []).shape == (len(a), 0)


def test_tiles_hold_few_values_and_stay_small(spark):
    """A block is dealt by names; one that would fill a tile goes to several, and each pair still meets once."""
    kind = "id long, name string, city string, state string"
    left = [(i, "same" if i % 2 else f"n{i}", None, "NY") for i in range(40)]
    right = [(100 + i, "same" if i % 3 else None, None, "NY") for i in range(30)]
    c = lk.Comparison("name", "jaro_winkler", (0.95,))
    rule = lk.Rule(("state",), lambda: F.col("state"))
    a, b = lk._tiles(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), (rule,), (c,), [], 5)
    ra, rb = a.collect(), b.collect()
    met = Counter((x["__id"], y["__id"]) for x in ra for y in rb if (x["__x"], x["__y"]) == (y["__x"], y["__y"]))
    assert len(met) == 40 * 30 and set(met.values()) == {1}
    homes = {}
    for x in ra:
        homes.setdefault(x["name"], set()).add(x["__x"])
    assert all(len(v) == 1 for k, v in homes.items() if k != "same") and len(homes["same"]) > 1


def test_contract_texts_are_dealt_to_tasks(spark):
    assert pc._contracts(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    texts = ["Hours of work 12, 14, 203", "Hours 12, 14", "12, 14, 203", "a....b", "Subject Page", "x\n y z 1,2,3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", ct.is_contents("text").alias("x"))
    assert {r.id: r.x for r in df.collect()} == {0: True, 1: False, 2: False, 3: True, 4: True, 5: True}


def test_two_hops_in_several_blocks(spark):
    r = random.Random(3)
    near = {tuple(sorted(r.sample(range(60), 2))) for _ in range(150)}
    side = {}
    for a, b in near:
        side.setdefault(a, set()).add(b)
        side.setdefault(b, set()).add(a)
    want = {(a, c): len(side[a] & side[c]) for a in side for c in side if a != c and c not in side[a] and side[a] & side[c]}
    for block in (7, 4096):
        got = st.two_hops(spark.createDataFrame([p if r.random() < 0.5 else p[::-1] for p in near], "a long, b long"), block).collect()
        assert len(got) == len(want) and {(x.a, x.c): x.via for x in got} == want
    assert st.two_hops(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_vectors_in_several_blocks(spark):
    r = random.Random(9)
    rows = {i: {k: r.randint(1, 9) for k in r.sample("abcdefgh", r.randint(1, 4))} for i in range(40)}
    df = spark.createDataFrame([(i, k, x) for i, v in rows.items() for k, x in v.items()], "r long, k string, x long")
    both = {(a, b): [(rows[a][k], rows[b][k]) for k in rows[a] if k in rows[b]] for a, b in itertools.combinations(rows, 2)}
    cosine = {p: (sum(x * y for x, y in v), len(v)) for p, v in both.items() if v}
    size = {i: sum(x * x for x in v.values()) ** 0.5 for i, v in rows.items()}
    for block in (6, 2048):
        got = st.sparse_cosine(df, "r", "k", "x", 0.3, block).collect()
        want = {p: (n, s / (size[p[0]] * size[p[1]])) for p, (s, n) in cosine.items() if s / (size[p[0]] * size[p[1]]) >= 0.3}
        assert len(got) == len(want) and {(x.a, x.b): (x.shared, x.cosine) for x in got} == want
        got = {(x.a, x.b): x.jaccard for x in st.weighted_jaccard(df, "r", "k", "x", block).collect()}
        low = {p: sum(min(xy) for xy in v) for p, v in both.items() if v}
        assert got == {(a, b): n / (sum(rows[a].values()) + sum(rows[b].values()) - n) for (a, b), n in low.items()}


def test_targets_of_one_name_are_met_as_one(spark):
    """The smallest id of several alike, and no more pairs than names."""
    kind = "id long, name string, ein string, city string, zip string, state string, street_no string"
    sources = m.with_keys(spark.createDataFrame([(1, "Delta Glas", None, None, None, "NY", None)], kind))
    targets = m.with_keys(spark.createDataFrame([(i, "Delta Glass", None, None, None, "NY", None) for i in range(30, 10, -1)] + [(9, "Delta Gloss", None, None, None, "NY", None)], kind))
    assert sn._pairs(sources.withColumn("__g", sim.trigrams("name_standard")), targets, sn.SCENARIO, ["__g"], ["name_standard"], firsts=True).count() == 2
    assert [(r.target_id, r.tier) for r in sn.scenario_match(sources, targets).collect()] == [(11, 5)]
