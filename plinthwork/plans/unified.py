"""The scorecard with all ten factors, its flags and snapshots; the target card of nine signals; source flags.

Violations, elections and charges come from line items and orders; the other facts of a customer, of which the
public tables hold none, are those of ``plans/signals.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import clamp, present, rounded, weighted_mean_present
from plinthwork.functions.storage import table
from plinthwork.operators import scoring as sc
from plinthwork.operators.relational import percent_rank_of_values
from plinthwork.plans import signals as sg
from plinthwork.plans.scorecards import AS_OF, R

FACTORS = ("osha", "nlrb", "whd", "contracts", "proximity", "growth", "financial", "size", "similarity")
DIRECT = ("osha", "nlrb", "whd", "contracts", "financial")
_RECENT = "1998-08-01"  # three years before


def _facts(spark, d):
    """One row a customer: raw facts, enforcement counts, and averages and wins nearby; each table is aggregated before it is joined."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    serious = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")
    items = l.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("willful"), F.count_if(F.col("l_returnflag") == "A").alias("repeat"), F.count_if(serious).alias("serious"), F.count(F.lit(1)).alias("total"), F.max(F.to_date("l_shipdate")).alias("inspected")
    )
    v = items.join(o.select("o_orderkey", F.col("o_custkey").alias("vk")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("vk").agg(*[F.sum(c).alias(c) for c in ("willful", "repeat", "serious", "total")], F.max("inspected").alias("inspected"))
    won, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    e = o.groupBy(F.col("o_custkey").alias("ek")).agg(
        F.count(F.lit(1)).alias("elections"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.max(F.to_date("o_orderdate")).alias("voted"), F.count_if(urgent).alias("charges"), F.max(F.when(urgent, F.to_date("o_orderdate"))).alias("charged"),
        F.count_if(~won & (F.col("o_orderkey") % 20 <= 5) & (F.col("o_orderkey") % 50 > 10)).alias("close"), F.count_if(won & (F.to_date("o_orderdate") >= F.lit(_RECENT))).alias("lately"),
    )
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nation"))
    f = sg.facts(spark, d).drop("osha", "nlrb").withColumn("naics4", F.concat("industry", (F.col("k") % 10).cast("string")))
    j = f.join(places, F.col("k") == F.col("ck")).join(v, F.col("k") == F.col("vk"), "left").join(e, F.col("k") == F.col("ek"), "left")
    weight = F.col("willful") * 3 + F.col("repeat") * 2 + F.col("serious") + (F.col("total") - F.col("willful") - F.col("repeat") - F.col("serious")) * 0.5
    near = lambda key, name, least: j.where(F.col("total").isNotNull()).groupBy(F.col(key).alias(name)).agg((F.sum(weight) / F.count(F.lit(1))).alias(f"avg_{name}"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    lately = lambda key, name: j.groupBy(F.col(key).alias(name)).agg(F.sum("lately").alias(f"won_{name}")).where(F.col(name).isNotNull())
    for key, name, side in (("naics4", "n4", near("naics4", "n4", 5)), ("industry", "n2", near("industry", "n2", 1)), ("industry", "i2", lately("industry", "i2")), ("nation", "st", lately("nation", "st"))):
        j = j.join(side, F.col(key) == F.col(name), "left")
    return j


def scored(spark, d):
    """Nine factors, research on top, both pillars and the composite score of each customer as of a fixed date."""
    day = F.to_date(F.lit(AS_OF))
    f = _facts(spark, d)
    workers = F.coalesce(*sg.SIZES)
    factors = f.select(
        "k", "nation", "charges", "inspected", "latest", "charged", "close", (F.col("k") % 4 == 3).alias("has_research"),
        sc.violations("willful", "repeat", "serious", "total", "inspected", F.coalesce("avg_n4", "avg_n2"), day).alias("osha"), sc.organizing("wins", "elections", "losses", "voted", "charges", "charged", "won_i2", "won_st", day).alias("nlrb"),
        sc.wage_cases("cases", "latest", day).alias("whd"), sc.contracts("federal", "obligations", "local", "sources").alias("contracts"), sc.proximity("members", "family").alias("proximity"), sc.growth("industry", "change").alias("growth"),
        sc.size(workers).alias("size"), sc.similarity("distance").alias("similarity"), sc.financial("revenue", "assets", "expenses", "s6", "listed", "participants", "plans", "pension", "welfare").alias("financial"),
    )
    k, found = F.col("k"), F.col("has_research")
    factors = factors.withColumns({
        "whd2": F.greatest("whd", F.when(found, (k % 10).cast("double"))), "contracts2": F.greatest("contracts", F.when(found & (k % 3 == 0), 9.0)), "sentiment": F.when(found & (k % 8 == 3), 0.5),
        "told": F.when(found & (k % 20 == 7), 6.5), "each": F.when(found & (k % 5 == 0), 600_000.0),
    })
    out = factors.withColumns({"anger": sc.anger("osha", "whd2", "nlrb", "charges", "sentiment", "told"), "leverage": sc.leverage("proximity", "similarity", "contracts2", "financial", "growth", "each")})
    out = out.withColumns({"factors": present(*FACTORS) + found.cast("int"), "direct": present(*DIRECT)})
    # As the scoring rule is written: least() skips nulls, so a row without any pillar scores the cap.
    capped = F.when((F.col("factors") < 3) & (F.col("direct") == 0), 7.0).otherwise(10.0)
    legacy = sc.legacy({"proximity": "proximity", "nlrb": "nlrb", "contracts": "contracts2", "growth": "growth", "financial": "financial", "osha": "osha", "whd": "whd2", "similarity": "similarity"})
    return out.withColumns({"score": F.least(rounded(weighted_mean_present([("anger", 3), ("leverage", 4)]), 2), capped), "legacy": legacy})


def scorecard_tiers(spark, d):
    """Factors, pillars, coverage, score, percentile, tier and change against the old score."""
    ranked = percent_rank_of_values(scored(spark, d), "score")
    return ranked.select(
        F.col("k").alias("c_custkey"), *FACTORS, rounded("anger").alias("anger"), rounded("leverage").alias("leverage"), F.col("factors").cast("long").alias("factors"), F.col("direct").cast("long").alias("direct"), "score", "legacy",
        rounded(F.col("score") - F.coalesce("legacy", F.lit(0.0)), 2).alias("delta"), rounded("percentile", 6).alias("percentile"), sc.tier("percentile", "factors", "direct").alias("tier"),
    )


def scorecard_flags(spark, d):
    """What a profile shows beside the tier: recent violations, contracts, enforcement of two kinds, a close election, thin data."""
    s = scored(spark, d)
    recent = [F.coalesce(F.col(c) >= F.to_date(F.lit("1999-08-01")), F.lit(False)) for c in ("inspected", "latest", "charged")]
    return s.select(
        F.col("k").alias("c_custkey"), (recent[0] | recent[1] | recent[2]).alias("has_recent_violations"), F.coalesce(F.col("contracts") > 0, F.lit(False)).alias("has_active_contracts"), (F.col("osha").isNotNull() & F.col("whd").isNotNull()).alias("has_compound_enforcement"),
        F.coalesce(F.col("close") > 0, F.lit(False)).alias("has_close_election"), (F.coalesce(F.col("score") >= 6.0, F.lit(False)) & (F.col("direct") == 0)).alias("has_thin_data"), F.col("has_research"), F.round(F.col("factors") * 10.0, 1).alias("coverage_pct"), F.round(F.col("direct") * 20.0, 1).alias("direct_pct"),
    )


def tier_migration(spark, d):
    """Tiers of the snapshot by the old score and of the one by the new score, and the moves between them."""
    both = percent_rank_of_values(percent_rank_of_values(scored(spark, d), "score").withColumnRenamed("percentile", "new_p"), "legacy").withColumnRenamed("percentile", "old_p")
    moves = both.select(sc.tier("old_p", "factors", "direct").alias("old_tier"), sc.tier("new_p", "factors", "direct").alias("new_tier"), rounded(F.col("score") - F.col("legacy"), 2).alias("delta"))
    return moves.groupBy("old_tier", "new_tier").agg(F.count(F.lit(1)).alias("moved"), F.max("delta").alias("largest_rise"), F.min("delta").alias("largest_fall"))


SIGNALS = ("s_osha", "s_whd", "s_nlrb", "s_contracts", "s_financial", "s_growth", "s_density", "s_size", "s_similarity")


def target_tiers(spark, d):
    """Nine signals of each target, and how many of each nation have so many: plain counts of violations, elections over wins, a flat federal score."""
    day = F.to_date(F.lit(AS_OF))
    f = _facts(spark, d)
    k, workers = F.col("k"), F.coalesce("s1", "s3", "s4")
    weight0 = sc.violations(F.lit(0), F.lit(0), "total", "total", "inspected", F.coalesce("avg_n4", "avg_n2"), day)  # every violation counts one
    bonus = F.when(F.col("willful") + F.col("repeat") > 0, 1.0).otherwise(0.0)
    flat = sc.contracts("federal", F.lit(0.0), "local", "sources")
    state, sector = F.when(k % 3 != 1, (k % 25).cast("double")), F.when(k % 4 != 1, (k % 17).cast("double"))
    s = f.select(
        "k", "nation", clamp(weight0 + bonus, 0.0, 10.0).alias("s_osha"), sc.wage_cases("cases", "latest", day).alias("s_whd"), sc.organizing("wins", "elections", "losses", "voted", "charges", "charged", "won_i2", "won_st", day, (1, 2, 0)).alias("s_nlrb"),
        F.when(F.col("federal"), F.greatest(flat, F.lit(5.0))).otherwise(flat).alias("s_contracts"), sc.financial("revenue", "assets", "expenses", "s1", "listed", "participants", "plans", "pension", "welfare").alias("s_financial"),
        sc.growth("industry", "change").alias("s_growth"), sc.density_signal(state, sector).alias("s_density"), sc.size(workers).alias("s_size"), sc.similarity("distance").alias("s_similarity"),
    )
    n = present(*SIGNALS)
    enforced = present("s_osha", "s_whd", "s_nlrb")
    tier = F.when((n >= 5) & (enforced >= 1), "gold").when((n >= 4) & (enforced >= 1), "silver").when(n >= 2, "bronze").otherwise("stub")
    per = s.select(F.col("nation").cast("long").alias("nation"), tier.alias("gold_tier"), n.alias("n"), *SIGNALS)
    return per.groupBy("nation", "gold_tier").agg(F.count(F.lit(1)).alias("targets"), F.sum("n").cast("long").alias("signals"), *[rounded(F.max(c), 2).alias(c) for c in SIGNALS])


SOURCES = ("osha", "nlrb", "whd", "n990", "sam", "sec", "gleif", "mergent", "corpwatch", "form5500", "ppp")


def source_flags(spark, d):
    """Which of eleven sources know a customer, how many of them count, and the best row of the crosswalk.

    Match tables are reduced to one row a customer before they are joined; the last source has a flag and counts nowhere.
    """
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    returned = l.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    osha = o.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("k1")).distinct()
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    log = o.groupBy(F.col("o_custkey").alias("k2")).agg(
        F.bool_or((status == "F") & (key % 3 == 0) | (priority == "1-URGENT") & (key % 4 == 1)).alias("nlrb"), F.bool_or(key % 5 == 0).alias("whd"), F.bool_or(F.col("o_totalprice") > 400_000).alias("n990"), F.bool_or(priority == "5-LOW").alias("sam"),
        F.bool_or(key % 7 == 1).alias("sec"), F.bool_or(key % 11 == 2).alias("gleif"), F.bool_or(key % 13 == 3).alias("mergent"), F.bool_or(key % 17 == 4).alias("corpwatch"), F.bool_or(key % 19 == 5).alias("form5500"), F.bool_or(key % 6 == 0).alias("ppp"),
        F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", key % 9, -key)).alias("best"),
    )
    c = table(spark, d, "customer").select("c_custkey")
    j = c.join(osha, F.col("c_custkey") == F.col("k1"), "left").join(log, F.col("c_custkey") == F.col("k2"), "left")
    flags = [F.col("k1").isNotNull().alias("has_osha"), *[F.coalesce(n, F.lit(False)).alias(f"has_{n}") for n in SOURCES[1:]]]
    out = j.select("c_custkey", *flags, F.col("best.o_orderkey").alias("crosswalk_id"), F.col("best.o_totalprice").alias("obligations"))
    return out.withColumn("source_count", sum((F.col(f"has_{n}").cast("long") for n in SOURCES[:-1]), F.lit(0).cast("long")))


_DECAY = "coalesce(exp(-ln(2.0::DOUBLE) / {h}::DOUBLE * greatest(0, date_diff('day', {c}, DATE '" + AS_OF + "')) / 365.25::DOUBLE), 1.0::DOUBLE)"
_LEAST = "least(10.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
_ULP = "CASE WHEN charges >= 10 THEN 8 WHEN charges >= 4 THEN 6 WHEN charges >= 2 THEN 4 WHEN charges = 1 THEN 2 ELSE 0 END * " + _DECAY.format(h=7, c="charged")
_NEAR = "CASE WHEN won_i2 >= 50 THEN 2.0 WHEN won_i2 >= 20 THEN 1.5 WHEN won_i2 >= 5 THEN 1.0 WHEN won_i2 >= 1 THEN 0.5 ELSE 0 END + CASE WHEN won_st >= 100 THEN 2.0 WHEN won_st >= 40 THEN 1.5 WHEN won_st >= 10 THEN 1.0 WHEN won_st >= 1 THEN 0.5 ELSE 0 END"
_AVERAGE = "greatest(coalesce(avg4, avg2, 2.23::DOUBLE), 0.1::DOUBLE)"
RAW = f"""{sg.FACTS_SQL}, {sg.FACTOR},
li AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') w, count(*) FILTER (l_returnflag = 'A') r, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') s, count(*) t, max(l_shipdate::DATE) i FROM lineitem GROUP BY 1),
vv AS (SELECT o_custkey vk, sum(w) willful, sum(r) repeat, sum(s) serious, sum(t) total, max(i) inspected, sum(w) * 3 + sum(r) * 2 + sum(s) + (sum(t) - sum(w) - sum(r) - sum(s)) * 0.5::DOUBLE weight FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
ee AS (SELECT o_custkey ek, count(*) elections, count(*) FILTER (o_orderstatus = 'F') wins, count(*) FILTER (o_orderstatus <> 'F') losses, max(o_orderdate::DATE) voted, count(*) FILTER (o_orderpriority = '1-URGENT') charges, max(o_orderdate::DATE) FILTER (o_orderpriority = '1-URGENT') charged,
 count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 20 <= 5 AND o_orderkey % 50 > 10) AS "close", count(*) FILTER (o_orderstatus = 'F' AND o_orderdate::DATE >= DATE '{_RECENT}') lately FROM orders GROUP BY 1),
jj AS (SELECT f.* EXCLUDE (osha, nlrb), f.industry || (f.k % 10)::VARCHAR n4, c_nationkey nation, vv.*, ee.* FROM f JOIN customer ON f.k = c_custkey LEFT JOIN vv ON f.k = vk LEFT JOIN ee ON f.k = ek),
a4 AS (SELECT n4, sum(weight)::DOUBLE / count(*) avg4 FROM jj WHERE total IS NOT NULL AND n4 IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), a2 AS (SELECT industry, sum(weight)::DOUBLE / count(*) avg2 FROM jj WHERE total IS NOT NULL AND industry IS NOT NULL GROUP BY 1),
m2 AS (SELECT industry, sum(lately) won_i2 FROM jj WHERE industry IS NOT NULL GROUP BY 1), ms AS (SELECT nation, sum(lately) won_st FROM jj GROUP BY 1),
raw AS (SELECT jj.*, avg4, avg2, coalesce(won_i2, 0) won_i2, coalesce(won_st, 0) won_st FROM jj LEFT JOIN a4 USING (n4) LEFT JOIN a2 USING (industry) LEFT JOIN m2 USING (industry) LEFT JOIN ms USING (nation))"""
_MEAN = lambda parts, extra: f"least(10.0::DOUBLE, ({' + '.join(f'coalesce({c}, 0) * {w}.0::DOUBLE' for c, w in parts)} + {extra}) / nullif(({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {w} END' for c, w in parts)})::DOUBLE, 0))"
_GUARD = lambda parts, extra: f"CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c, _ in parts)} THEN {_MEAN(parts, extra)} END"
_ANGER = (("osha", 3), ("whd2", 3), ("nlrb", 3), ("ulps", 4))
_LEVERAGE = (("proximity", 10), ("similarity", 15), ("contracts2", 25), ("financial", 25), ("growth", 10))
_OLD = (("proximity", 3), ("nlrb", 3), ("contracts2", 2), ("growth", 2), ("financial", 2), ("osha", 1), ("whd2", 1), ("similarity", 1))
_SUM = lambda parts: f"({' + '.join(f'coalesce({c}, 0) * {w}.0::DOUBLE' for c, w in parts)}) / nullif(({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {w} END' for c, w in parts)})::DOUBLE, 0)"
_COUNT = lambda names: "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in names) + ")"
SCORED = f"""{RAW}, x AS (SELECT raw.k, nation, charges, inspected, raw.latest, charged, "close", raw.k % 4 = 3 has_research,
CASE WHEN total IS NOT NULL THEN least(10.0::DOUBLE, greatest(0.0::DOUBLE, {R(f"weight / {_AVERAGE} * {_DECAY.format(h=5, c='inspected')}", 2)}) + CASE WHEN willful + repeat > 0 THEN 1 ELSE 0 END) END osha,
CASE WHEN elections IS NOT NULL THEN {_LEAST.format(x=R(f"(wins * 2 + elections - losses) * {_DECAY.format(h=7, c='voted')} + {_ULP} + {_NEAR}", 2))} END nlrb, g.whd, g.contracts, g.proximity, g.growth, g.financial, g.size, g.similarity FROM raw JOIN g ON raw.k = g.k),
y AS (SELECT *, greatest(whd, CASE WHEN has_research THEN (k % 10)::DOUBLE END) whd2, greatest(contracts, CASE WHEN has_research AND k % 3 = 0 THEN 9.0::DOUBLE END) contracts2, CASE WHEN has_research AND k % 8 = 3 THEN 5.0::DOUBLE ELSE 0 END feel, CASE WHEN has_research AND k % 20 = 7 THEN 6.5::DOUBLE END told,
CASE WHEN has_research AND k % 5 = 0 THEN 10 ELSE 0 END rich, CASE WHEN charges >= 10 THEN 10 WHEN charges >= 4 THEN 8 WHEN charges >= 2 THEN 6 WHEN charges = 1 THEN 4 END ulps FROM x),
z AS (SELECT *, coalesce(told, {_GUARD(_ANGER, 'feel')}) anger, {_GUARD(_LEVERAGE, 'rich')} leverage, {_COUNT(FACTORS)} + has_research::INT factors, {_COUNT(DIRECT)} direct, {R(_SUM(_OLD), 2)} legacy FROM y),
sc AS (SELECT *, least({R(_SUM((("anger", 3), ("leverage", 4))), 2)}, CASE WHEN factors < 3 AND direct = 0 THEN 7.0::DOUBLE ELSE 10.0::DOUBLE END) score FROM z)"""
_TIER = "CASE WHEN {p} >= 0.97 AND factors >= 3 AND direct >= 1 THEN 'Priority' WHEN {p} >= 0.85 AND factors >= 3 AND direct >= 1 THEN 'Strong' WHEN {p} >= 0.60 AND direct >= 1 THEN 'Promising' WHEN {p} >= 0.85 THEN 'Speculative' WHEN {p} >= 0.25 THEN 'Moderate' ELSE 'Low' END"
TIERS = f"""WITH {SCORED}, rk AS (SELECT *, percent_rank() OVER (ORDER BY score ASC NULLS FIRST) pr FROM sc)
SELECT k c_custkey, {", ".join(FACTORS)}, {R("anger")} anger, {R("leverage")} leverage, factors::BIGINT factors, direct::BIGINT direct, score, legacy, {R("score - coalesce(legacy, 0)", 2)} delta, {R("pr", 6)} percentile, {_TIER.format(p="pr")} tier FROM rk"""
FLAGS = f"""WITH {SCORED} SELECT k c_custkey, coalesce(inspected >= DATE '1999-08-01', false) OR coalesce(latest >= DATE '1999-08-01', false) OR coalesce(charged >= DATE '1999-08-01', false) has_recent_violations, coalesce(contracts > 0, false) has_active_contracts, osha IS NOT NULL AND whd IS NOT NULL has_compound_enforcement,
coalesce("close" > 0, false) has_close_election, coalesce(score >= 6.0, false) AND direct = 0 has_thin_data, has_research, (factors * 10.0)::DOUBLE coverage_pct, (direct * 20.0)::DOUBLE direct_pct FROM sc"""
MIGRATION = f"""WITH {SCORED}, rk AS (SELECT *, percent_rank() OVER (ORDER BY score ASC NULLS FIRST) pn, percent_rank() OVER (ORDER BY legacy ASC NULLS FIRST) po, {R("score - legacy", 2)} delta FROM sc)
SELECT {_TIER.format(p="po")} old_tier, {_TIER.format(p="pn")} new_tier, count(*) moved, max(delta) largest_rise, min(delta) largest_fall FROM rk GROUP BY 1, 2"""
_WORKERS = "coalesce(s1, s3, s4)"
_TARGETS = f"""{RAW}, t AS (SELECT raw.k, nation, CASE WHEN total IS NOT NULL THEN least(10.0::DOUBLE, least(10.0::DOUBLE, greatest(0.0::DOUBLE, {R(f"total / {_AVERAGE} * {_DECAY.format(h=5, c='inspected')}", 2)})) + CASE WHEN willful + repeat > 0 THEN 1 ELSE 0 END) END s_osha, g.whd s_whd,
CASE WHEN elections IS NOT NULL THEN {_LEAST.format(x=R(f"(elections * 2 + wins) * {_DECAY.format(h=7, c='voted')} + {_ULP} + {_NEAR}", 2))} END s_nlrb,
CASE WHEN federal OR coalesce(local, false) THEN greatest(CASE WHEN federal THEN 5 ELSE 0 END, CASE WHEN coalesce(local, false) THEN CASE WHEN sources >= 4 THEN 8 WHEN sources = 3 THEN 6 WHEN sources = 2 THEN 5 ELSE 3 END ELSE 0 END)::DOUBLE END s_contracts,
greatest(CASE WHEN revenue IS NOT NULL THEN least(10, CASE WHEN revenue >= 10000000 THEN 6 WHEN revenue >= 1000000 THEN 4 WHEN revenue >= 100000 THEN 2 ELSE 0 END + CASE WHEN coalesce(assets, 0) > coalesce(expenses, 1) * 2 THEN 2 WHEN coalesce(assets, 0) > coalesce(expenses, 1) THEN 1 ELSE 0 END + CASE WHEN revenue / greatest(coalesce(s1, 1), 1) >= 50000 THEN 2 WHEN revenue / greatest(coalesce(s1, 1), 1) >= 20000 THEN 1 ELSE 0 END) WHEN listed THEN 7 END,
 CASE WHEN participants IS NOT NULL THEN least(10, CASE WHEN participants >= 1000 THEN 3 WHEN participants >= 500 THEN 2 WHEN participants >= 100 THEN 1 ELSE 0 END + CASE WHEN plans >= 5 THEN 4 WHEN plans >= 3 THEN 3 WHEN plans >= 2 THEN 2 ELSE 1 END + CASE WHEN pension THEN 2 ELSE 0 END + CASE WHEN welfare THEN 1 ELSE 0 END) END)::DOUBLE s_financial, g.growth s_growth,
CASE WHEN raw.k % 3 <> 1 OR raw.k % 4 <> 1 THEN {_LEAST.format(x=R("(CASE WHEN raw.k % 3 <> 1 THEN raw.k % 25 ELSE 0 END * 0.5::DOUBLE + CASE WHEN raw.k % 4 <> 1 THEN raw.k % 17 ELSE 0 END * 0.5::DOUBLE) / 4.0::DOUBLE", 2))} END s_density,
(CASE WHEN {_WORKERS} IS NULL THEN NULL WHEN {_WORKERS} < 15 THEN 0.0 WHEN {_WORKERS} BETWEEN 500 AND 25000 THEN 10.0 WHEN {_WORKERS} > 25000 THEN greatest(5.0::DOUBLE, 10.0::DOUBLE - {R(f"({_WORKERS} - 25000) / 75000.0::DOUBLE * 5.0::DOUBLE", 2)}) ELSE {R(f"({_WORKERS} - 15) / 485.0::DOUBLE * 10.0::DOUBLE", 2)} END)::DOUBLE s_size, g.similarity s_similarity FROM raw JOIN g ON raw.k = g.k),
n AS (SELECT *, {_COUNT(SIGNALS)} n, {_COUNT(("s_osha", "s_whd", "s_nlrb"))} e FROM t)"""
TARGETS = f"""WITH {_TARGETS} SELECT nation::BIGINT nation, CASE WHEN n >= 5 AND e >= 1 THEN 'gold' WHEN n >= 4 AND e >= 1 THEN 'silver' WHEN n >= 2 THEN 'bronze' ELSE 'stub' END gold_tier, count(*) targets, sum(n)::BIGINT signals, {", ".join(f"{R(f'max({c})', 2)} {c}" for c in SIGNALS)} FROM n GROUP BY 1, 2"""
SOURCE_FLAGS = f"""WITH r AS (SELECT DISTINCT o_custkey k1 FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey k2, bool_or((o_orderstatus = 'F' AND o_orderkey % 3 = 0) OR (o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 1)) nlrb, bool_or(o_orderkey % 5 = 0) whd, bool_or(o_totalprice > 400000) n990, bool_or(o_orderpriority = '5-LOW') sam, bool_or(o_orderkey % 7 = 1) sec, bool_or(o_orderkey % 11 = 2) gleif, bool_or(o_orderkey % 13 = 3) mergent, bool_or(o_orderkey % 17 = 4) corpwatch, bool_or(o_orderkey % 19 = 5) form5500, bool_or(o_orderkey % 6 = 0) ppp FROM orders GROUP BY 1),
b AS (SELECT DISTINCT ON (o_custkey) o_custkey k3, o_orderkey crosswalk_id, o_totalprice obligations FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey % 9 DESC, o_orderkey),
f AS (SELECT c_custkey, k1 IS NOT NULL has_osha, {", ".join(f"coalesce({n}, false) has_{n}" for n in SOURCES[1:])}, crosswalk_id, obligations FROM customer LEFT JOIN r ON c_custkey = k1 LEFT JOIN g ON c_custkey = k2 LEFT JOIN b ON c_custkey = k3)
SELECT *, ({" + ".join(f"has_{n}::INT" for n in SOURCES[:-1])})::BIGINT source_count FROM f"""

SQL = {"scorecard_tiers": TIERS, "scorecard_flags": FLAGS, "tier_migration": MIGRATION, "target_tiers": TARGETS, "source_flags": SOURCE_FLAGS}
QUERIES = {name: globals()[name] for name in SQL}
