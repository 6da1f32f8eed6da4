"""Logistic models, out-of-fold scores, ranges of errors, and runs in slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinthwork.operators import models as md
from plinthwork.streaming import slices


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 2)) * [2, 0.5] + [1, -3]
    y = (r.random(900) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 1.5 * x[:, 1] - 5)))).astype(int)
    rows = [(int(i) // 6, float(a), float(b), 7.0, int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return rows, spark.createDataFrame([*rows, (None, None, 1.0, 7.0, 1)], "g long, a double, b double, c double, y int")


def newton(z, y, ridge=1.0):
    x, w = np.column_stack([np.ones(len(z)), z]), np.zeros(z.shape[1] + 1)
    pen = np.array([0, *[ridge] * z.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
    return w


def test_coefficients_are_those_of_a_closed_check(data):
    rows, df = data
    known = df.where("g is not null")
    z = md.standard(known, ["a", "b", "c"])
    got = md.logistic(z, ["z_a", "z_b"], "y", rounds=50)[md.ALL]
    m = np.array([[r[1], r[2]] for r in rows])
    assert np.abs(got - newton((m - m.mean(0)) / m.std(0), np.array([r[4] for r in rows]))).max() < 1e-6
    flat = md.logistic(z, ["z_a", "z_c"], "y", rounds=50)[md.ALL]
    assert abs(flat[2]) < 1e-9  # a constant feature
    assert (md.logistic(z.where("y = 1"), ["z_a"], "y")[md.ALL] == 0).all() and (md.logistic(z.limit(0), ["z_a"], "y")[md.ALL] == 0).all()
    weights = md.suggested_weights({"a": 3.0, "b": -1.0})
    assert weights == {"a": 7.5, "b": 2.5} and md.suggested_weights({"a": 0.0}) == {"a": 0.0}


def test_no_fold_learns_from_its_own_groups(data):
    rows, df = data
    folded = md.standard(df.where("g is not null"), ["a", "b"]).withColumn("fold", md.fold_of("g", 4)).cache()
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    weights = md.logistic(folded, ["z_a", "z_b"], "y", "fold", 4)
    again = md.logistic(folded.repartition(7), ["z_a", "z_b"], "y", "fold", 4)
    assert all(np.abs(weights[m] - again[m]).max() < 1e-9 for m in weights)
    # Labels of a fold turned round change every model but its own.
    turned = folded.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    other = md.logistic(turned, ["z_a", "z_b"], "y", "fold", 4)
    assert np.abs(other[2] - weights[2]).max() < 1e-9 and all(np.abs(other[m] - weights[m]).max() > 1e-3 for m in (md.ALL, 0, 1, 3))
    scored = md.scored_out_of_fold(folded, ["z_a", "z_b"], weights, "fold").collect()
    for r in scored[:50]:
        w = weights[r.fold]
        assert abs(r.probability - 1 / (1 + np.exp(-(w[0] + w[1] * r.z_a + w[2] * r.z_b)))) < 1e-12


def test_ranges_are_within_half_a_bin_of_the_exact_ones(spark):
    r = random.Random(9)
    rows = [(r.choice("AB"), r.choice("xy"), r.choice(["c", "d"]), r.gauss(0, 4)) for _ in range(800)] + [("C", "x", "c", 1.0)] * 3 + [("A", "x", "c", None)]
    got = {(q.cell1, q.cell2, q.category): q for q in md.error_ranges(spark.createDataFrame(rows, "n string, t string, k string, e double"), ("n", "t"), "k", "e", width=0.02, least=10).collect()}
    for n in ("A", "B", "*"):
        for t in ("x", "y", "*"):
            for k in ("c", "d"):
                e = [v for a, b, c, v in rows if (n == "*" or a == n) and (t == "*" or b == t) and c == k and v is not None]
                q = got[n, t, k]
                assert q.n == len(e) and abs(q.low - np.percentile(e, 15)) <= 0.01 + 1e-9 and abs(q.high - np.percentile(e, 85)) <= 0.01 + 1e-9
    assert not any(k[0] == "C" for k in got)


def test_a_killed_run_resumes(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    records = spark.range(40).withColumn("v", F.col("id") * 2)
    calls = []

    def match(df, fail_at=None):
        calls.append(1)
        if fail_at == len(calls):
            raise RuntimeError("killed")
        return df.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "HIGH").otherwise("LOW").alias("band"))

    with pytest.raises(RuntimeError, match="killed"):
        slices.resume(records, lambda df: match(df, 3), root, 4, "r1")
    assert [r.slice for r in slices.ledger(spark, root)] == [0, 1]
    assert slices.resume(records, match, root, 4, "r1") == [2, 3]
    assert slices.resume(records, match, root, 4, "r1") == []
    got = slices.results(spark, root, 4)
    assert got.count() == 20 and got.select("id").distinct().count() == 20 and sum(r.records for r in slices.ledger(spark, root)) == 40
    # Another run replaces one slice only; other counts begin a new ledger.
    assert slices.run_slice(records, lambda df: match(df).limit(0), root, 1, 4, "r2")
    kept = slices.results(spark, root, 4)
    assert kept.where("run_id = 'r2'").count() == 0 and kept.count() < 20
    assert slices.run_slice(records.where("id < 39"), match, root, 0, 4, "r2") and [r.slice for r in slices.ledger(spark, root)] == [0]
    assert slices.results(spark, f"{root}-none", 4) is None
