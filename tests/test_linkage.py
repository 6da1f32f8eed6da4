"""Record linkage, collisions of the cascade, master deduplication and the identity graph."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plinthwork.functions import similarity as sim
from plinthwork.operators import linkage as lk
from plinthwork.operators import masters as ms
from plinthwork.operators import matching as m
from plinthwork.operators import scenarios as sn

NAME, CITY = lk.Comparison("name", "jaro_winkler", (0.95, 0.88)), lk.Comparison("city", "levenshtein", (1, 2))
STATE = lk.Comparison("state", frequency=True)
COMPARISONS = (NAME, CITY, STATE)
BLOCKS = (lk.Rule(("state",), lambda: F.col("state")), lk.Rule(("name",), lambda: F.substring("name", 1, 2)))


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(1)
    names = ["acme steel", "blue river", "cedar mills", "delta glass", "eastern foods", "acme steal"]
    row = lambda i: (i, r.choice([*names, None]), r.choice(["york", "yorks", "leeds", None]), r.choice(["NY", "OH", None]))
    kind = "id long, name string, city string, state string"
    left, right = [row(i) for i in range(23)], [row(i + 100) for i in range(31)]
    return left, right, spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)


def plain_level(c, a, b):
    if a is None or b is None:
        return -1
    if a == b:
        return c.levels - 1
    if c.kind == "jaro_winkler":
        return sum(sim.jaro_winkler(a, b) >= t for t in c.at)
    if c.kind == "levenshtein":
        d = {"york": {"yorks": 1}, "yorks": {"york": 1}}.get(a, {}).get(b, 5)
        return sum(d <= t for t in c.at)
    return 0


def pattern(x, y):
    return tuple(plain_level(c, x[i], y[i]) for i, c in ((1, NAME), (2, CITY), (3, STATE)))


@pytest.mark.parametrize("tile", [2, 512])
def test_patterns_are_counted_and_pairs_come_once(sides, tile):
    left, right, dl, dr = sides
    met = [(x, y) for x, y in itertools.product(left, right) if x[3] and x[3] == y[3]]
    want = {}
    for x, y in met:
        want[pattern(x, y)] = want.get(pattern(x, y), 0) + 1
    assert lk.pattern_counts(dl, dr, BLOCKS[0], COMPARISONS, tile=tile) == want
    model = lk.Model(COMPARISONS, {"name": [0.01, 0.04, 0.05, 0.9], "city": [0.05, 0.05, 0.1, 0.8], "state": [0.1, 0.9]}, {"name": [0.7, 0.1, 0.1, 0.1], "city": [0.6, 0.1, 0.1, 0.2], "state": [0.5, 0.5]}, prior=0.3)
    blocked = [(x, y) for x, y in itertools.product(left, right) if x[3] and x[3] == y[3] or x[1] and y[1] and x[1][:2] == y[1][:2]]
    states = [x[3] for x in left + right if x[3]]

    def probability(x, y):
        w = math.log2(0.3 / 0.7)
        for c, level in zip(COMPARISONS, pattern(x, y)):
            if level >= 0:
                w += math.log2(model.m[c.column][level] / model.u[c.column][level])
        if x[3] and x[3] == y[3]:
            w += math.log2(0.5) - math.log2(states.count(x[3]) / len(states))
        return 1 / (1 + 2**-w)

    got = {(r.a, r.b): r for r in lk.link(dl, dr, model, BLOCKS, least=0.2, tile=tile).collect()}
    want = {(x[0], y[0]): probability(x, y) for x, y in blocked if probability(x, y) >= 0.2}
    assert set(got) == set(want) and all(abs(got[k].probability - p) < 1e-9 for k, p in want.items())
    assert all((r.band, r.status) == (("HIGH", "auto_accept") if r.probability >= 0.85 else ("MEDIUM", "needs_review") if r.probability >= 0.7 else ("LOW", "rejected")) for r in got.values())


def test_dedupe_gives_each_pair_in_order(sides):
    left, _, dl, _ = sides
    model = lk.Model(COMPARISONS, {"name": [0.1] * 3 + [0.7], "city": [0.1] * 3 + [0.7], "state": [0.1, 0.9]}, {"name": [0.25] * 4, "city": [0.25] * 4, "state": [0.5, 0.5]}, prior=0.5)
    got = [(r.a, r.b) for r in lk.link(dl, dl, model, BLOCKS, least=0.0, dedupe=True, tile=3).collect()]
    want = {(x[0], y[0]) for x, y in itertools.combinations(left, 2) if x[3] and x[3] == y[3] or x[1] and y[1] and x[1][:2] == y[1][:2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_maximisation_recovers_what_made_the_pairs():
    r = random.Random(3)
    m_, u = {"name": [0.02, 0.03, 0.05, 0.90], "city": [0.1, 0.1, 0.1, 0.7], "state": [0.05, 0.95]}, {"name": [0.9, 0.05, 0.03, 0.02], "city": [0.7, 0.1, 0.1, 0.1], "state": [0.8, 0.2]}
    counts = {}
    for _ in range(60_000):
        p = m_ if r.random() < 0.2 else u
        k = tuple(r.choices(range(c.levels), p[c.column])[0] for c in COMPARISONS)
        counts[k] = counts.get(k, 0) + 1
    got = lk.maximise(counts, COMPARISONS, u, rounds=100, tolerance=1e-6)
    assert abs(got["match"] - 0.2) < 0.01 and all(abs(a - b) < 0.02 for c in m_ for a, b in zip(got["m"][c], m_[c]))
    assert "state" not in lk.maximise(counts, COMPARISONS, u, fixed=("state",))["m"]
    empty = lk.maximise({}, COMPARISONS, u)
    assert empty["pairs"] == 0 and abs(sum(empty["m"]["name"]) - 1) < 1e-9


def test_training_without_records(spark):
    none = spark.createDataFrame([], "id long, name string, city string, state string")
    model = lk.train(none, none, COMPARISONS, BLOCKS)
    assert lk.link(none, none, model, BLOCKS).count() == 0 and model.u["name"] == [0.0] * 4


def test_collisions_are_weighed(spark):
    """Two candidates in other cities: the likelier one is taken; two alike stay ambiguous, and so do unlike names."""
    kind = "id long, name string, ein string, city string, zip string, state string"
    targets = m.with_keys(spark.createDataFrame([(1, "Acme Works", None, "albany", None, "NY"), (2, "Acme Works", None, "utica", None, "NY"), (3, "Blue Mills", None, "troy", None, "NY"), (4, "Blue Mills", None, "troy", None, "NY")], kind))
    sources = m.with_keys(spark.createDataFrame([(10, "acme works", None, "albani", None, "NY"), (11, "blue mills", None, "troy", None, "NY"), (12, "acme works", None, None, None, "NY")], kind))
    model = lk.Model((NAME, CITY, lk.Comparison("state")), {"name": [0.1, 0.1, 0.1, 0.7], "city": [0.05, 0.05, 0.4, 0.5], "state": [0.1, 0.9]}, {"name": [0.97, 0.01, 0.01, 0.01], "city": [0.9, 0.04, 0.03, 0.03], "state": [0.9, 0.1]}, prior=0.01)
    got = {r.id: r for r in m.match_cascade(sources, targets, model=model).collect()}
    assert (got[10].target_id, got[10].method) == (1, "NAME_STATE_EXACT_SPLINK_RESOLVED") and 0.5 < got[10].score < 1
    assert got[11].method.startswith("AMBIGUOUS_") and got[12].method.startswith("AMBIGUOUS_") and got[11].score == 0
    strict = {r.id: r for r in m.match_cascade(sources, targets, model=model, name_floor=1.01).collect()}
    assert strict[10].method == "AMBIGUOUS_NAME_STATE_EXACT"


MASTER = "id long, name string, city string, state string, zip string, naics string, ein string, employees long, employees_source string, origin string, protected boolean, sources array<string>, is_union boolean, is_public boolean, is_contractor boolean, is_nonprofit boolean"


def master(i, name, *, city=None, state="NY", zip=None, naics=None, ein=None, employees=None, origin="sam", protected=False, union=False):
    return (i, name, city, state, zip, naics, ein, employees, None, origin, protected, [origin] + (["f7"] if protected else []), union, False, None, False)


def test_phases_carry_survivors_and_protect(spark):
    rows = [
        master(1, "acme steel works", ein="E1", origin="f7", protected=True), master(2, "acme steel works", ein="E1", origin="mergent", zip="12345", employees=40, union=True), master(3, "steel works acme", origin="sec", zip="12345-9", city="albany"),
        master(4, "acme steel works", origin="f7", protected=True, zip="12345"),  # never into another protected one
        master(5, "other name", ein="E1", origin="bmf", state="OH"),  # an equal number, but neither name nor state
        master(6, "gamma long name", origin="gleif"), master(7, "gamma long names", origin="sam"),  # nowhere: by the start of the name
        master(8, None, ein="E9"), master(9, "", ein="E9"), master(None, "lost"),
    ]
    masters, log, members = ms.dedup_masters(spark.createDataFrame(rows, MASTER).withColumn("note", F.lit("x")))
    merged = {(r.loser, r.winner, r.phase) for r in log.collect()}
    assert merged == {(2, 1, "ein"), (3, 1, "name_geo_3a"), (6, 7, "name_geo_3c"), (9, 8, "ein")}
    got = {r.id: r for r in masters.collect()}
    assert set(got) == {1, 4, 5, 7, 8} and got[1].employees == 40 and got[1].is_union and (got[1].zip, got[1].city, got[1].note, got[1].quality) == ("12345-9", "albany", "x", 60)
    assert {r.id: r.master for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 7, 7: 7, 8: 8, 9: 8}
    assert got[7].name == "gamma long names" and got[7].quality == 20


def test_a_block_that_is_too_large_is_left_alone(spark):
    rows = [master(i, f"same name {'x' * (i % 2)}", zip="55555", origin="sam") for i in range(12)]
    phase = ms.Phase("zip", ("left(zip, 5)",), 0.82, 11)
    data = spark.createDataFrame(rows, MASTER)
    assert ms.merges_of(data, phase).count() == 0 and ms.merges_of(data.where("id < 11"), phase).count() == 10
    assert all(x.count() == 0 for x in ms.dedup_masters(data.limit(0)))


def test_identity_graph_parts_at_conflicts(spark):
    nodes = spark.createDataFrame([(i, n) for i, n in enumerate([None, "E1", None, "E2", None, None, None, "E3", "E3"])], "node long, identifier string")
    edges = spark.createDataFrame([(1, 0, "sure"), (3, 2, "sure"), (0, 2, "name"), (4, 5, "name"), (5, 6, "name"), (6, 7, "name"), (7, 8, "name"), (5, 99, "name")], "a long, b long, tier string")
    got = {r.node: (r.family, r.tier) for r in ms.crosswalk(nodes, edges, {"sure": 0, "name": 1}).collect()}
    assert got == {0: (0, "sure"), 1: (0, "sure"), 2: (2, "sure"), 3: (2, "sure"), 4: (4, "name"), 5: (4, "name"), 6: (4, "name"), 7: (4, "name"), 8: (4, "name")}
    # What joins two numbers through unknown ones is parted, and the unknown ones stay together.
    bridge = spark.createDataFrame([(1, 4, "name"), (4, 5, "name"), (5, 3, "name")], "a long, b long, tier string")
    got = {r.node: r.family for r in ms.crosswalk(nodes, bridge, {"name": 0}).collect()}
    assert got[1] == 1 and got[3] == 3 and got[4] == got[5] == 4


def test_the_surest_tier_wins(spark):
    kind = "id long, name string, ein string, city string, zip string, state string, street_no string"
    sources = m.with_keys(spark.createDataFrame([(1, "Acme Steel", "E1", "york", None, "NY", "5"), (2, "Blue River Svcs", None, "york", None, "NY", "9"), (3, "Cedar", None, None, None, None, None), (4, "Delta Glas", None, "troy", None, "NY", None)], kind))
    targets = m.with_keys(spark.createDataFrame([(10, "Acme Steel", None, "york", None, "NY", "5"), (11, "Zeta", "E1", None, None, "OH", None), (12, "Blue River Group", None, "york", None, "NY", "9"), (13, "Blue River", None, "york", None, "NY", "9"), (14, "Delta Glass", None, None, None, "NY", None)], kind))
    got = {r.id: (r.target_id, r.tier, r.method, r.confidence) for r in sn.scenario_match(sources, targets).collect()}
    assert got == {1: (11, 1, "EIN", "HIGH"), 2: (13, 3, "ADDRESS", "HIGH"), 4: (14, 5, "FUZZY", "LOW")}
    assert sn.scenario_match(sources.limit(0), targets).count() == 0


def test_orphans_are_matched_anew(spark):
    orphans = spark.createDataFrame(
        [(1, "Acme Steel Inc", "acme steel inc", "acme steel", "NY", "10001", "york"), (2, "Fund 3", "fund 3", "fund", "NY", None, None), (3, "Blue River", "blue river", "blue river", "NY", "10001", None), (4, None, None, None, "NY", None, None), (5, "Nobody Here", "nobody here", "nobody here", "OH", None, None)],
        "id long, name string, name_standard string, name_aggressive string, state string, zip string, city string",
    )
    records = spark.createDataFrame(
        [("w1", "whd", "Acme Steel", "ACME STEEL", "NY", "10001", "york", None), ("s1", "sam", "ACME STEEL INC", "acme steel inc", "NY", "10001", "york", None), ("o1", "osha", "Fund", "fund", "NY", None, None, None), ("n1", "990", "Blue River", "blue river", "NY", "99999", None, "E7"), ("o2", "osha", "Blue River", "blue river", "NY", None, None, None)],
        "id string, source string, name string, name_norm string, state string, zip string, city string, ein string",
    )
    best, review = sn.rematch_orphans(orphans, records)
    got = {r.id: (r.target_id, r.method, r.score) for r in best.collect()}
    assert got[1] == ("s1", "NAME_STANDARD_STATE_ZIP_EXACT", 1.0) and got[3] == ("o2", "NAME_STANDARD_STATE_EXACT", 0.98)
    assert 4 not in got and 5 not in got and all(r.tier == "tier_C_review" for r in review.collect())
