"""Aggregates under the scorecards, and companions: win rates, wage outliers, union health, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import clamp, ladder, ratio, rounded, weighted_mean_present
from plinthwork.functions.storage import table

AS_OF = "2001-08-01"


def _day(c: str):
    return F.to_date(c)


def violations(spark, d):
    """One row a customer: counts by severity, penalties and last date, aggregated before any join."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("willful"), F.count_if(F.col("l_returnflag") == "A").alias("repeat"), F.count_if(F.col("l_returnflag") == "N").alias("serious"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("penalty"), F.max(_day("l_shipdate")).alias("last_inspection"),
    )
    owner = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return items.join(owner, items["l_orderkey"] == owner["o_orderkey"]).groupBy("o_custkey").agg(
        *[F.sum(c).alias(c) for c in ("willful", "repeat", "serious", "penalty")], F.max("last_inspection").alias("last_inspection")
    )


def elections(spark, d):
    o = table(spark, d, "orders")
    won = F.col("o_orderstatus")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("elections"), F.count_if(won == "F").alias("wins"), F.count_if(won == "O").alias("losses"), F.max(_day("o_orderdate")).alias("last_election"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("obligations"),
    )


def R(x: str, n: int = 4) -> str:
    """SQL of the shared rounding."""
    k = f"{10**n}.0::DOUBLE"
    return f"(floor(({x}) * {k} + 0.5) / {k})::DOUBLE"


def win_rate_patterns(spark, d):
    """Win rates by industry, size bucket and state; blended to a predicted rate over what is known."""
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    bucket = F.when(F.col("o_totalprice") < 50000, "S").when(F.col("o_totalprice") < 200000, "M").otherwise("L")
    cases = o.where("o_orderstatus in ('F', 'O')").join(c, o["o_custkey"] == c["c_custkey"]).select("c_mktsegment", "c_nationkey", bucket.alias("bucket"), (F.col("o_orderstatus") == "F").cast("int").alias("won"))

    def rate(key, least):
        g = cases.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w")).where(F.col("n") >= least)
        return g.select(F.col(key).alias(f"k_{key}"), (F.col("w") / F.col("n")).alias(f"r_{key}"))

    keys = cases.groupBy("c_mktsegment", "bucket", "c_nationkey").agg(F.count(F.lit(1)).alias("cases"), F.sum("won").cast("long").alias("wins"))
    for key, least in (("c_mktsegment", 10), ("bucket", 10), ("c_nationkey", 10)):
        r = rate(key, least)
        keys = keys.join(r, keys[key] == r[f"k_{key}"], "left")
    total = cases.agg((F.sum("won") / F.count(F.lit(1))).alias("overall"))
    predicted = F.coalesce("r_c_mktsegment", "overall") * 0.35 + F.coalesce("r_bucket", "overall") * 0.35 + F.coalesce("r_c_nationkey", "overall") * 0.20 + F.col("overall") * 0.10
    return keys.join(F.broadcast(total)).join(n, F.col("c_nationkey") == n["n_nationkey"]).select("c_mktsegment", "bucket", "n_name", "cases", "wins", rounded(predicted * 100, 2).alias("predicted_pct"))


WIN_RATES = f"""WITH k AS (SELECT c_mktsegment, CASE WHEN o_totalprice < 50000 THEN 'S' WHEN o_totalprice < 200000 THEN 'M' ELSE 'L' END bucket, c_nationkey, (o_orderstatus = 'F')::INT won FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')),
a AS (SELECT c_mktsegment x, sum(won)::DOUBLE / count(*) r FROM k GROUP BY 1 HAVING count(*) >= 10), b AS (SELECT bucket x, sum(won)::DOUBLE / count(*) r FROM k GROUP BY 1 HAVING count(*) >= 10), n AS (SELECT c_nationkey x, sum(won)::DOUBLE / count(*) r FROM k GROUP BY 1 HAVING count(*) >= 10), t AS (SELECT sum(won)::DOUBLE / count(*) r FROM k),
g AS (SELECT c_mktsegment, bucket, c_nationkey, count(*) cases, sum(won)::BIGINT wins FROM k GROUP BY 1, 2, 3)
SELECT g.c_mktsegment, g.bucket, n_name, cases, wins, {R("(coalesce(a.r, t.r) * 0.35::DOUBLE + coalesce(b.r, t.r) * 0.35::DOUBLE + coalesce(n.r, t.r) * 0.20::DOUBLE + t.r * 0.10::DOUBLE) * 100", 2)} predicted_pct FROM g CROSS JOIN t LEFT JOIN a ON a.x = g.c_mktsegment LEFT JOIN b ON b.x = g.bucket LEFT JOIN n ON n.x = g.c_nationkey JOIN nation ON n_nationkey = g.c_nationkey"""


def wage_outliers(spark, d):
    """Own rate against the benchmark of the best source that has a sane one, and a step score."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    own = l.groupBy("l_partkey").agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) / F.sum(F.col("l_quantity").cast("decimal(18,2)"))).cast("double").alias("pay"))
    bench = p.groupBy("p_brand").agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")) / F.count(F.lit(1))).cast("double").alias("benchmark")).withColumnRenamed("p_brand", "brand")
    j = p.join(own, p["p_partkey"] == own["l_partkey"], "left").join(bench, p["p_brand"] == bench["brand"])
    source = F.when(F.col("pay").between(100, 100000), "items").when(F.col("p_retailprice") > 0, "list")
    pay = F.when(F.col("pay").between(100, 100000), F.col("pay")).when(F.col("p_retailprice") > 0, F.col("p_retailprice"))
    r = ratio(pay, "benchmark")
    return j.select("p_partkey", source.alias("source"), rounded(r, 3).alias("ratio"), ladder(rounded(r, 3), [(1.2, 0), (1.0, 2), (0.8, 5), (0.6, 8)], 10).cast("long").alias("score"))


WAGE_OUTLIERS = f"""WITH o AS (SELECT l_partkey, (sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE) pay FROM lineitem GROUP BY 1), b AS (SELECT p_brand, sum(p_retailprice::DECIMAL(18,2))::DOUBLE / count(*) bm FROM part GROUP BY 1),
j AS (SELECT p_partkey, CASE WHEN pay BETWEEN 100 AND 100000 THEN 'items' WHEN p_retailprice > 0 THEN 'list' END source, CASE WHEN pay BETWEEN 100 AND 100000 THEN pay WHEN p_retailprice > 0 THEN p_retailprice END / nullif(bm, 0) q FROM part LEFT JOIN o ON p_partkey = l_partkey JOIN b USING (p_brand)), k AS (SELECT p_partkey, source, {R("q", 3)} ratio FROM j)
SELECT *, (CASE WHEN ratio IS NULL THEN NULL WHEN ratio >= 1.2 THEN 0 WHEN ratio >= 1.0 THEN 2 WHEN ratio >= 0.8 THEN 5 WHEN ratio >= 0.6 THEN 8 ELSE 10 END)::BIGINT score FROM k"""


def union_health(spark, d):
    """Growth, win rate and asset ratio of a nation, their mean over what is present, and a grade."""
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    y = F.year("o_orderdate")
    per = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(
        F.count_if(y == 1996).alias("first"), F.count_if(y == 2000).alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("held"))
    cagr = F.when((F.col("first") > 0) & (F.col("last") > 0), (F.pow(F.col("last") / F.col("first"), F.lit(0.25)) - 1) * 100)
    growth = clamp(F.lit(50.0) + cagr / 5 * 50, 0.0, 100.0)
    wins = F.when(F.col("held") >= 3, F.col("won") / F.col("held") * 100)
    health = per.select("c_nationkey", growth.alias("growth"), wins.alias("wins"))
    score = rounded(weighted_mean_present([("growth", 1), ("wins", 1)]), 2)
    grade = F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("F")
    return health.join(n, health["c_nationkey"] == n["n_nationkey"]).select("n_name", rounded("growth", 2).alias("growth"), rounded("wins", 2).alias("wins"), score.alias("score"), grade.alias("grade"))


UNION_HEALTH = f"""WITH p AS (SELECT c_nationkey, count(*) FILTER (year(o_orderdate) = 1996) f, count(*) FILTER (year(o_orderdate) = 2000) l, count(*) FILTER (o_orderstatus = 'F') won, count(*) FILTER (o_orderstatus IN ('F', 'O')) held FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
h AS (SELECT c_nationkey, CASE WHEN f > 0 AND l > 0 THEN least(greatest(50.0::DOUBLE + (pow(l::DOUBLE / f, 0.25::DOUBLE) - 1) * 100 / 5 * 50, 0.0::DOUBLE), 100.0::DOUBLE) END growth, CASE WHEN held >= 3 THEN won::DOUBLE / held * 100 END wins FROM p),
s AS (SELECT *, {R("(coalesce(growth, 0) + coalesce(wins, 0)) / nullif((CASE WHEN growth IS NULL THEN 0 ELSE 1 END + CASE WHEN wins IS NULL THEN 0 ELSE 1 END)::DOUBLE, 0)", 2)} score FROM h)
SELECT n_name, {R("growth", 2)} growth, {R("wins", 2)} wins, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END grade FROM s JOIN nation ON n_nationkey = c_nationkey"""


def violation_flags(spark, d):
    """Recent, compound and thin-data flags, and a margin test on close elections."""
    v, e = violations(spark, d), elections(spark, d)
    j = v.join(e.withColumnRenamed("o_custkey", "e_key"), v["o_custkey"] == F.col("e_key"), "full_outer")
    recent = F.col("last_inspection") >= F.to_date(F.lit(AS_OF)) - F.expr("INTERVAL 2 YEARS")
    return j.select(F.coalesce("o_custkey", "e_key").alias("custkey"), F.coalesce(recent, F.lit(False)).alias("recent"), (F.coalesce(F.col("willful") > 5, F.lit(False)) & F.coalesce(F.col("losses") > 3, F.lit(False))).alias("compound"), (F.coalesce(F.abs(F.col("wins") - F.col("losses")) <= 1, F.lit(False)) & (F.col("elections") > 4)).alias("close"), F.col("penalty").cast("double").alias("penalty"))


VIOLATION_FLAGS = f"""WITH v0 AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') w, sum(l_extendedprice::DECIMAL(18,2)) p, max(l_shipdate::DATE) li FROM lineitem GROUP BY 1), v AS (SELECT o_custkey, sum(w) w, sum(p) p, max(li) li FROM v0 JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
e AS (SELECT o_custkey, count(*) n, count(*) FILTER (o_orderstatus = 'F') won, count(*) FILTER (o_orderstatus = 'O') lost FROM orders GROUP BY 1)
SELECT coalesce(v.o_custkey, e.o_custkey) custkey, coalesce(li >= DATE '{AS_OF}' - INTERVAL 2 YEARS, false) recent, coalesce(w > 5, false) AND coalesce(lost > 3, false) compound, coalesce(abs(won - lost) <= 1, false) AND n > 4 AS close, p::DOUBLE penalty FROM v FULL OUTER JOIN e ON v.o_custkey = e.o_custkey"""

QUERIES = {f.__name__: f for f in (win_rate_patterns, wage_outliers, union_health, violation_flags)}
SQL = {"win_rate_patterns": WIN_RATES, "wage_outliers": WAGE_OUTLIERS, "union_health": UNION_HEALTH, "violation_flags": VIOLATION_FLAGS}
