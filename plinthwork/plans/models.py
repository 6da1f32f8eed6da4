"""Weights of the pillars by logistic regression, gates judged out of fold, ranges of errors with their fallbacks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import cut, table
from plinthwork.operators import models as md
from plinthwork.operators import relational as rel
from plinthwork.plans import unified as un
from plinthwork.plans.scorecards import R

FEATURES, FOLDS, ROUNDS = ["anger", "leverage"], 5, 6


def _elections(spark, d):
    """Every order as an election with its customer's pillars; folds keep a customer's elections together."""
    s = cut(un.scored(spark, d).select("k", *FEATURES), "pillars").where("anger is not null and leverage is not null")  # written: else the filter would repeat the whole score
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("won"))
    return cut(o.join(s, F.col("o_custkey") == F.col("k")).withColumn("fold", md.fold_of("k", FOLDS)), "elections")


def pillar_weights(spark, d):
    """Standardised coefficients of the pillars for won elections, odds, and the weights that they suggest."""
    z = md.standard(_elections(spark, d), FEATURES)
    w = md.logistic(z, ["z_anger", "z_leverage"], "won", rounds=ROUNDS, tolerance=0.0)[md.ALL]
    told = md.suggested_weights(dict(zip(FEATURES, map(float, w[1:]))))
    rows = [(n, float(c), math.exp(c), told[n]) for n, c in zip(FEATURES, map(float, w[1:]))] + [("intercept", float(w[0]), math.exp(float(w[0])), None)]
    return spark.createDataFrame(rows, "term string, coefficient double, odds double, suggested double").select("term", *[rounded(c, 5).alias(c) for c in ("coefficient", "odds", "suggested")])


def gate_metrics(spark, d):
    """Accuracy of each fold by the model that never saw its customers, with the share that it would let through."""
    z = cut(md.standard(_elections(spark, d), FEATURES), "scaled")
    names = ["z_anger", "z_leverage"]
    out = md.scored_out_of_fold(z, names, md.logistic(z, names, "won", "fold", FOLDS, rounds=ROUNDS, tolerance=0.0), "fold")
    right = ((F.col("probability") >= 0.5).cast("int") == F.col("won")).cast("double")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("groups"), rounded(F.avg(right)).alias("accuracy"), rounded(F.avg("probability"), 5).alias("mean"), rounded(F.avg((F.col("probability") >= 0.33).cast("double"))).alias("passed"))


def _errors(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    tier = F.when(F.col("c_nationkey") % 4 == 0, "Low").when(F.col("c_nationkey") % 4 == 1, "Med-Low").when(F.col("c_nationkey") % 4 == 2, "Med-High").otherwise("High")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", tier.alias("tier"), F.col("o_orderpriority").alias("category"), ((F.col("o_totalprice") - 150000) / 5000).alias("error"))


def prediction_ranges(spark, d):
    """Ranges that hold 70 of 100 errors, by industry and tier, by either, and over all."""
    r = md.error_ranges(_errors(spark, d), ("c_mktsegment", "tier"), "category", "error", width=0.05, least=100)
    return r.select("cell1", "cell2", "category", "n", rounded("low", 6).alias("low"), rounded("high", 6).alias("high"))


def range_lookup(spark, d):
    """The range of the narrowest cell that has one, for each industry, tier and category: both, industry, tier, all."""
    e = _errors(spark, d)
    r = md.error_ranges(e, ("c_mktsegment", "tier"), "category", "error", width=0.05, least=100)
    asked = e.select("c_mktsegment", "tier", "category").distinct()
    ways = [("c_mktsegment", "tier"), ("c_mktsegment", None), (None, "tier"), (None, None)]
    keys = F.array(*[F.struct(F.lit(i).alias("step"), (F.col(a) if a else F.lit("*")).alias("cell1"), (F.col(b) if b else F.lit("*")).alias("cell2")) for i, (a, b) in enumerate(ways)])
    met = asked.select("*", F.explode(keys).alias("w")).select("c_mktsegment", "tier", "category", "w.*").join(r, ["cell1", "cell2", "category"])
    best = rel.first_by(met, ["c_mktsegment", "tier", "category"], [F.asc("step")])
    return best.select("c_mktsegment", "tier", "category", F.col("step").cast("long").alias("step"), "n", rounded("low", 6).alias("low"), rounded("high", 6).alias("high"))


_X = ("1", "z1", "z2")
_DET = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
_INV = ((("h11 * h22 - h12 * h12"), ("h02 * h12 - h01 * h22"), ("h01 * h12 - h02 * h11")), (("h02 * h12 - h01 * h22"), ("h00 * h22 - h02 * h02"), ("h01 * h02 - h00 * h12")), (("h01 * h12 - h02 * h11"), ("h01 * h02 - h00 * h12"), ("h00 * h11 - h01 * h01")))


def _newton_sql():
    """Six steps for the model of all rows (-1) and of each fold left out, as tables of weights."""
    out = [f"gw0 AS (SELECT m, 0.0::DOUBLE b0, 0.0::DOUBLE b1, 0.0::DOUBLE b2 FROM range(-1, {FOLDS}) g(m))"]
    for r in range(ROUNDS):
        sums = ", ".join([f"sum((won - p) * {x}) - {'b' + str(i) if i else '0'} * 1.0 * {1 if i else 0} s{i}" for i, x in enumerate(_X)] + [f"sum(p * (1 - p) * {_X[i]} * {_X[j]}) + {1.0 if i == j and i else 0.0}::DOUBLE h{i}{j}" for i in range(3) for j in range(i, 3)])
        steps = ", ".join(f"b{i} + ({' + '.join(f'({_INV[i][j]}) * s{j}' for j in range(3))}) / {_DET} b{i}" for i in range(3))
        out.append(f"gt{r} AS (SELECT m, b0, b1, b2, won, z1, z2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) p FROM gw{r} JOIN zz ON m = -1 OR fold <> m), ga{r} AS (SELECT m, b0, b1, b2, {sums} FROM gt{r} GROUP BY m, b0, b1, b2), gw{r + 1} AS (SELECT m, {steps} FROM ga{r})")
    return ", ".join(out)


_ZZ = f"""ev AS (SELECT k, (o_orderstatus = 'F')::INT won, anger, leverage, CAST('0x' || substr(md5(k::VARCHAR), 1, 8) AS BIGINT) % {FOLDS} fold FROM orders JOIN sc ON o_custkey = k WHERE anger IS NOT NULL AND leverage IS NOT NULL),
zz AS (SELECT k, won, fold, (anger - avg(anger) OVER ()) / stddev_pop(anger) OVER () z1, (leverage - avg(leverage) OVER ()) / stddev_pop(leverage) OVER () z2 FROM ev), {_newton_sql()}"""
WEIGHTS = f"""WITH {un.SCORED}, {_ZZ}, fin AS (SELECT * FROM gw{ROUNDS} WHERE m = -1)
SELECT term, {R('c', 5)} coefficient, {R('exp(c)', 5)} odds, CASE WHEN s IS NOT NULL THEN {R('s', 5)} END suggested FROM (SELECT 'intercept' term, b0 c, NULL::DOUBLE s FROM fin UNION ALL SELECT 'anger', b1, 10 * abs(b1) / (abs(b1) + abs(b2)) FROM fin UNION ALL SELECT 'leverage', b2, 10 * abs(b2) / (abs(b1) + abs(b2)) FROM fin)"""
GATES = f"""WITH {un.SCORED}, {_ZZ}, o AS (SELECT fold, k, won, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) p FROM zz JOIN gw{ROUNDS} ON m = fold)
SELECT fold, count(*) n, count(DISTINCT k) groups, {R('avg(((p >= 0.5)::INT = won)::INT::DOUBLE)')} accuracy, {R('avg(p)', 5)} mean, {R('avg((p >= 0.33)::INT::DOUBLE)')} passed FROM o GROUP BY 1"""
_RANGES = f"""er AS (SELECT c_mktsegment, CASE c_nationkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Med-Low' WHEN 2 THEN 'Med-High' ELSE 'High' END tier, o_orderpriority category, (floor((o_totalprice - 150000) / 5000 / 0.05::DOUBLE) + 0.5) * 0.05::DOUBLE e FROM orders JOIN customer ON o_custkey = c_custkey),
ex AS (SELECT c_mktsegment cell1, tier cell2, category, e FROM er UNION ALL SELECT c_mktsegment, '*', category, e FROM er UNION ALL SELECT '*', tier, category, e FROM er UNION ALL SELECT '*', '*', category, e FROM er),
rg AS (SELECT cell1, cell2, category, count(*) n, quantile_cont(e, 0.15) low, quantile_cont(e, 0.85) high FROM ex GROUP BY 1, 2, 3 HAVING count(*) >= 100)"""
RANGES = f"WITH {_RANGES} SELECT cell1, cell2, category, n, {R('low', 6)} low, {R('high', 6)} high FROM rg"
LOOKUP = f"""WITH {_RANGES}, q AS (SELECT DISTINCT c_mktsegment, tier, category FROM er)
SELECT c_mktsegment, tier, q.category, (CASE WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 1 WHEN c.n IS NOT NULL THEN 2 ELSE 3 END)::BIGINT step, coalesce(a.n, b.n, c.n, z.n) n, {R('coalesce(a.low, b.low, c.low, z.low)', 6)} low, {R('coalesce(a.high, b.high, c.high, z.high)', 6)} high FROM q LEFT JOIN rg a ON a.cell1 = c_mktsegment AND a.cell2 = tier AND a.category = q.category
LEFT JOIN rg b ON b.cell1 = c_mktsegment AND b.cell2 = '*' AND b.category = q.category LEFT JOIN rg c ON c.cell1 = '*' AND c.cell2 = tier AND c.category = q.category LEFT JOIN rg z ON z.cell1 = '*' AND z.cell2 = '*' AND z.category = q.category WHERE coalesce(a.n, b.n, c.n, z.n) IS NOT NULL"""

SQL = {"pillar_weights": WEIGHTS, "gate_metrics": GATES, "prediction_ranges": RANGES, "range_lookup": LOOKUP}
QUERIES = {name: globals()[name] for name in SQL}
