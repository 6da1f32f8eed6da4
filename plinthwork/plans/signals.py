"""Score factors, signals and filters over facts that both sides derive from the public tables by the same short formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import scoring as sc
from plinthwork.plans.scorecards import R

AS_OF = "2001-08-01"
#: Facts of a customer, in SQL that Spark and its twin both read: the public tables hold no such records.
FACTS = {
    "cases": "CASE WHEN k % 4 <> 0 THEN n % 6 END", "latest": "CASE WHEN k % 5 <> 0 THEN recent END", "federal": "k % 3 = 0", "obligations": "CASE WHEN k % 6 <> 0 THEN total * (k % 9) END", "local": "CASE WHEN k % 7 <> 0 THEN k % 5 < 2 END",
    "sources": "k % 6", "members": "CASE WHEN k % 7 <> 0 THEN k % 4 END", "family": "CASE WHEN k % 11 = 0 THEN k END", "industry": "CASE WHEN k % 10 <> 0 THEN cast(k % 90 + 10 AS varchar(9)) END", "change": "CASE WHEN k % 13 <> 0 THEN cast(k % 60 - 30 AS double) END",
    "s1": "CASE WHEN k % 8 = 0 THEN k * 300 END", "s2": "CASE WHEN k % 9 = 0 THEN k * 7 END", "s3": "CASE WHEN k % 12 = 0 THEN k END", "s4": "CASE WHEN k % 10 = 1 THEN k * 2 END", "s5": "CASE WHEN k % 5 = 2 THEN k % 400 END", "s6": "CASE WHEN k % 2 = 0 THEN k % 40 END",
    "distance": "CASE WHEN k % 3 = 1 THEN cast(k % 50 AS double) / 100.0 END", "revenue": "CASE WHEN k % 4 = 1 THEN total END", "assets": "CASE WHEN k % 8 = 1 THEN total * cast(k % 5 AS double) END", "expenses": "CASE WHEN k % 16 <> 1 THEN total END",
    "listed": "k % 17 = 0", "participants": "CASE WHEN k % 5 = 0 THEN k END", "plans": "CASE WHEN k % 15 <> 0 THEN k % 7 END", "pension": "k % 2 = 0", "welfare": "k % 20 = 0", "nlrb": "CASE WHEN k % 3 <> 2 THEN cast(n % 11 AS double) END", "osha": "CASE WHEN k % 2 = 1 THEN cast(k % 11 AS double) END",
}
PER = "SELECT c_custkey k, coalesce(n, 0) n, coalesce(total, 0.0) total, recent FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) total, max(cast(o_orderdate AS date)) recent FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"
FACTS_SQL = f"f AS (SELECT k, {', '.join(f'{e} {n}' for n, e in FACTS.items())} FROM ({PER}))"


def facts(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max(F.to_date("o_orderdate")).alias("recent"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    per = c.join(o, c["k"] == o["o_custkey"], "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), "recent")
    return per.select("k", *[F.expr(e).alias(n) for n, e in FACTS.items()])


SIZES = ["s1", "s2", "s3", "s4", "s5", "s6"]


def _factors(f):
    workers = F.coalesce(*SIZES)
    return f.select(
        "k", "nlrb", "osha", sc.wage_cases("cases", "latest", F.to_date(F.lit(AS_OF))).alias("whd"), sc.contracts("federal", "obligations", "local", "sources").alias("contracts"), sc.proximity("members", "family").alias("proximity"),
        sc.growth("industry", "change").alias("growth"), workers.alias("workers"), sc.size_source(SIZES).alias("source"), sc.size(workers).alias("size"), sc.similarity("distance").alias("similarity"),
        sc.financial("revenue", "assets", "expenses", "s6", "listed", "participants", "plans", "pension", "welfare").alias("financial"),
    )


def factor_scores(spark, d):
    """Wage cases, contracts, proximity, growth, size with its source, similarity and finances of each customer."""
    return _factors(facts(spark, d)).drop("nlrb", "osha")


_W = "coalesce(s1, s2, s3, s4, s5, s6)"
FACTOR = f"""g AS (SELECT k, nlrb, osha, {R(f"(CASE WHEN cases >= 4 THEN 10.0 WHEN cases >= 2 THEN 7.0 WHEN cases = 1 THEN 5.0 WHEN cases = 0 THEN 0.0 END)::DOUBLE * coalesce(exp(-ln(2.0::DOUBLE) / 5.0::DOUBLE * greatest(0, date_diff('day', latest, DATE '{AS_OF}')) / 365.25::DOUBLE), 1.0::DOUBLE)", 2)} whd,
CASE WHEN federal OR coalesce(local, false) THEN greatest(CASE WHEN federal AND coalesce(obligations, 0) > 0 THEN CASE WHEN obligations >= 100000000 THEN 10 WHEN obligations >= 10000000 THEN 8 WHEN obligations >= 1000000 THEN 6 WHEN obligations >= 100000 THEN 4 ELSE 2 END WHEN federal THEN 1 ELSE 0 END, CASE WHEN coalesce(local, false) THEN CASE WHEN sources >= 4 THEN 8 WHEN sources = 3 THEN 6 WHEN sources = 2 THEN 5 ELSE 3 END ELSE 0 END)::DOUBLE END contracts,
CASE WHEN members IS NULL AND family IS NULL THEN NULL WHEN coalesce(members, 1) >= 3 THEN 10.0 WHEN coalesce(members, 1) = 2 OR family IS NOT NULL THEN 5.0 ELSE 0.0 END::DOUBLE proximity,
CASE WHEN industry IS NOT NULL THEN least(10.0, greatest(0.0, {R("(coalesce(change, 0.0) + 10.0::DOUBLE) / 20.0::DOUBLE * 10.0::DOUBLE", 2)}))::DOUBLE END growth, {_W} workers,
CASE WHEN s1 IS NOT NULL THEN 'mergent_company' WHEN s2 IS NOT NULL THEN 'sec_10k' WHEN s3 IS NOT NULL THEN 'ppp_2020' WHEN s4 IS NOT NULL THEN 'rpe_estimate' WHEN s5 IS NOT NULL THEN 'f7_group_consolidated' WHEN s6 IS NOT NULL THEN 'f7_unit_size' END AS source,
(CASE WHEN {_W} IS NULL THEN NULL WHEN {_W} < 15 THEN 0.0 WHEN {_W} BETWEEN 500 AND 25000 THEN 10.0 WHEN {_W} > 25000 THEN greatest(5.0::DOUBLE, 10.0::DOUBLE - {R(f"({_W} - 25000) / 75000.0::DOUBLE * 5.0::DOUBLE", 2)}) ELSE {R(f"({_W} - 15) / 485.0::DOUBLE * 10.0::DOUBLE", 2)} END)::DOUBLE AS size,
CASE WHEN distance IS NOT NULL THEN least(10.0, greatest(0.0, {R("(1.0::DOUBLE - distance / 0.40::DOUBLE) * 10.0::DOUBLE", 1)}))::DOUBLE END similarity,
greatest(CASE WHEN revenue IS NOT NULL THEN least(10, CASE WHEN revenue >= 10000000 THEN 6 WHEN revenue >= 1000000 THEN 4 WHEN revenue >= 100000 THEN 2 ELSE 0 END + CASE WHEN coalesce(assets, 0) > coalesce(expenses, 1) * 2 THEN 2 WHEN coalesce(assets, 0) > coalesce(expenses, 1) THEN 1 ELSE 0 END + CASE WHEN revenue / greatest(coalesce(s6, 1), 1) >= 50000 THEN 2 WHEN revenue / greatest(coalesce(s6, 1), 1) >= 20000 THEN 1 ELSE 0 END) WHEN listed THEN 7 END,
 CASE WHEN participants IS NOT NULL THEN least(10, CASE WHEN participants >= 1000 THEN 3 WHEN participants >= 500 THEN 2 WHEN participants >= 100 THEN 1 ELSE 0 END + CASE WHEN plans >= 5 THEN 4 WHEN plans >= 3 THEN 3 WHEN plans >= 2 THEN 2 ELSE 1 END + CASE WHEN pension THEN 2 ELSE 0 END + CASE WHEN welfare THEN 1 ELSE 0 END) END)::DOUBLE financial FROM f)"""

PARTS = ("proximity", "nlrb", "contracts", "growth", "financial", "osha", "whd", "similarity")
WEIGHTS = (3, 3, 2, 2, 2, 1, 1, 1)


def research_enhanced(spark, d):
    """Factors raised, never lowered, by researched ones; a researched size fills a missing one. Old and new weighted score, and their difference."""
    g = _factors(facts(spark, d))
    found = g.select("k", F.expr("CASE WHEN k % 6 = 0 THEN cast(k % 10 AS double) END").alias("r_whd"), F.expr("CASE WHEN k % 6 = 1 THEN 9.0D END").alias("r_contracts"), F.expr("CASE WHEN k % 6 = 2 THEN k END").alias("r_workers")).where("k % 2 = 0 OR k % 3 = 1").withColumnRenamed("k", "rk")
    j = g.join(found, g["k"] == found["rk"], "left").select(g["*"], F.greatest("whd", "r_whd").alias("whd2"), F.greatest("contracts", "r_contracts").alias("contracts2"), F.coalesce("workers", "r_workers").alias("workers2"))
    j = j.withColumn("old", sc.legacy({p: p for p in PARTS})).withColumn("new", sc.legacy({p: p + "2" if p in ("whd", "contracts") else p for p in PARTS}))
    return j.select("k", "whd2", "contracts2", "workers2", "old", "new", rounded(F.col("new") - F.col("old"), 2).alias("delta"))


def _legacy_sql(names):
    top = " + ".join(f"coalesce({c}, 0.0::DOUBLE) * {w}.0::DOUBLE" for c, w in zip(names, WEIGHTS))
    low = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}.0::DOUBLE ELSE 0.0::DOUBLE END" for c, w in zip(names, WEIGHTS))
    return R(f"({top}) / nullif({low}, 0)", 2)


ENHANCED = f"""WITH {FACTS_SQL}, {FACTOR}, r AS (SELECT *, CASE WHEN k % 6 = 0 THEN greatest(whd, (k % 10)::DOUBLE) ELSE whd END whd2, CASE WHEN k % 6 = 1 THEN greatest(contracts, 9.0::DOUBLE) ELSE contracts END contracts2, coalesce(workers, CASE WHEN k % 6 = 2 THEN k END) workers2 FROM g),
s AS (SELECT *, {_legacy_sql(PARTS)} AS old, {_legacy_sql([p + "2" if p in ("whd", "contracts") else p for p in PARTS])} AS new FROM r) SELECT k, whd2, contracts2, workers2, old, new, {R("new - old", 2)} delta FROM s"""


def density_signals(spark, d):
    """State and sector density of each customer as one signal; sectors come from two-digit industries."""
    f = facts(spark, d).select("k", sc.sector("industry").alias("sector"), (F.col("k") % 25).alias("state"))
    per = f.where("sector is not null").groupBy("sector").agg((F.count(F.lit(1)) % 37).cast("double").alias("sector_density"))
    j = f.join(per, "sector", "left").withColumn("state_density", F.when(F.col("state") % 4 != 0, F.col("state").cast("double")))
    return j.select("k", "sector", sc.density_signal("state_density", "sector_density").alias("signal"))


_SECTOR = "CASE left(industry, 2) WHEN '11' THEN 'AGR_MIN' WHEN '21' THEN 'AGR_MIN' WHEN '22' THEN 'TRANS_UTIL' WHEN '23' THEN 'CONST' WHEN '31' THEN 'MFG' WHEN '32' THEN 'MFG' WHEN '33' THEN 'MFG' WHEN '42' THEN 'WHOLESALE' WHEN '44' THEN 'RETAIL' WHEN '45' THEN 'RETAIL' WHEN '48' THEN 'TRANS_UTIL' WHEN '49' THEN 'TRANS_UTIL' WHEN '51' THEN 'INFO' WHEN '52' THEN 'FINANCE' WHEN '53' THEN 'FINANCE' WHEN '54' THEN 'PROF_BUS' WHEN '55' THEN 'PROF_BUS' WHEN '56' THEN 'PROF_BUS' WHEN '61' THEN 'EDU_HEALTH' WHEN '62' THEN 'EDU_HEALTH' WHEN '71' THEN 'LEISURE' WHEN '72' THEN 'LEISURE' WHEN '81' THEN 'OTHER' WHEN '92' THEN 'PUBLIC_ADMIN' END"
DENSITY = f"""WITH {FACTS_SQL}, s AS (SELECT k, {_SECTOR} sector, k % 25 st FROM f), p AS (SELECT sector, (count(*) % 37)::DOUBLE i FROM s WHERE sector IS NOT NULL GROUP BY 1), j AS (SELECT k, s.sector, CASE WHEN st % 4 <> 0 THEN st::DOUBLE END sd, i FROM s LEFT JOIN p ON s.sector = p.sector)
SELECT k, sector, CASE WHEN sd IS NOT NULL OR i IS NOT NULL THEN least(10.0, greatest(0.0, {R("(coalesce(sd, 0.0) * 0.5::DOUBLE + coalesce(i, 0.0) * 0.5::DOUBLE) / 4.0::DOUBLE", 2)}))::DOUBLE END signal FROM j"""

TIERS = ("Priority", "Strong", "Promising", "Moderate", "Low")


def recommended_actions(spark, d):
    """The action that a tier, enforcement and the factors known call for."""
    f = facts(spark, d).withColumn("tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("k") % 5 + 1).cast("int")))
    enforced = F.col("cases").isNotNull() & (F.col("cases") > 2)
    return f.select("k", "tier", sc.recommended_action("tier", enforced, F.col("k") % 6).alias("action"))


ACTIONS = f"""WITH {FACTS_SQL}, t AS (SELECT k, ['Priority', 'Strong', 'Promising', 'Moderate', 'Low'][k % 5 + 1] tier, coalesce(cases > 2, false) e, k % 6 n FROM f)
SELECT k, tier, CASE WHEN tier = 'Priority' AND e THEN 'PURSUE NOW' WHEN tier IN ('Priority', 'Strong') AND n >= 3 THEN 'RESEARCH FIRST' WHEN tier IN ('Promising', 'Moderate') AND e THEN 'RESEARCH FIRST' WHEN n < 3 THEN 'INSUFFICIENT DATA' ELSE 'MONITOR' END action FROM t"""

#: Texts of parties and the employer in each, written out.
PARTIES = (("ACME CORP", "ACME CORP"), ("Smith, John", None), ("SMITH, John Q.", None), ("Smith, John\nAcme Steel", "Acme Steel"), ("Smith, John\nFisher Counsel LLP", None), ("Smith, John\nDoe, Jane", None), ("Law Offices of Doe", None), ("Doe, P.C.", None), (" \n Blue River Foods \n", "Blue River Foods"), ("ab", None), ("", None), ("Delta, Inc. of Ohio", "Delta, Inc. of Ohio"))


def party_employers(spark, d):
    """The employer named in each party text, and how many customers have such a text."""
    texts = F.array(*[F.lit(p) for p, _ in PARTIES])
    c = table(spark, d, "customer").select(F.element_at(texts, (F.col("c_custkey") % len(PARTIES) + 1).cast("int")).alias("party"))
    return c.withColumn("employer", sc.employer_of("party")).groupBy("party", "employer").agg(F.count(F.lit(1)).alias("n"))


def _text(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


PARTY = f"WITH p(i, party, employer) AS (VALUES {', '.join(f'({i}, {_text(p)}, {_text(e)})' for i, (p, e) in enumerate(PARTIES))}) SELECT party, employer, count(*) n FROM customer JOIN p ON c_custkey % {len(PARTIES)} = i GROUP BY 1, 2"

#: What a parser may take for a name, and whether it can be one, written out.
NAMES = (("Jane Q. Doe", True), ("Chief Executive", False), ("DEF 14A", False), ("Khosla Ventures, LLC", False), ("2026 Proxy Statement 15", False), ("Al Bo", True), ("Cher", False), ("A B", False), ("The Board", False), ("John Smith since 1995", False), ("Mary and her sister", False), (None, False), ("Anna-Maria de la Cruz", True), ("12 Main", False))


def director_names(spark, d):
    """Which of the texts found as directors' names can be names."""
    texts = F.array(*[F.lit(n) for n, _ in NAMES])
    c = table(spark, d, "customer").select("c_custkey", F.element_at(texts, (F.col("c_custkey") % len(NAMES) + 1).cast("int")).alias("name"))
    return c.select("c_custkey", "name", sc.likely_name("name").alias("likely"))


DIRECTORS = f"WITH p(i, name, likely) AS (VALUES {', '.join(f'({i}, {_text(n)}, {str(e).lower()})' for i, (n, e) in enumerate(NAMES))}) SELECT c_custkey, name, likely FROM customer JOIN p ON c_custkey % {len(NAMES)} = i"


def score_eligible(spark, d):
    """Matches that count: by identity, or sure enough; with totals by method."""
    o = table(spark, d, "orders").select(F.element_at(F.array(*[F.lit(m) for m in ("EIN_EXACT", "NAME_STATE_EXACT", "CIK_BRIDGE", "FUZZY_TRIGRAM")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("method"), ((F.col("o_custkey") % 100) / 100.0).alias("score"))
    return o.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(sc.score_eligible("method", "score")).alias("eligible"), rounded(F.avg(sc.score_eligible("method", "score").cast("double"))).alias("share"))


ELIGIBLE = f"WITH m AS (SELECT ['EIN_EXACT', 'NAME_STATE_EXACT', 'CIK_BRIDGE', 'FUZZY_TRIGRAM'][o_orderkey % 4 + 1] AS method, (o_custkey % 100) / 100.0::DOUBLE score FROM orders), e AS (SELECT method, method IN ('EIN_EXACT', 'CROSSWALK', 'CIK_BRIDGE') OR score >= 0.85 ok FROM m) SELECT method, count(*) n, count(*) FILTER (ok) eligible, {R('avg(ok::INT::DOUBLE)')} AS share FROM e GROUP BY 1"


def demographic_bounds(spark, d):
    """What is implausible about a group's workers and the shares of five dimensions; some states' numbers are unknown."""
    k = F.col("c_custkey")
    pct = lambda *xs: F.array(*[x.cast("double") for x in xs])
    c = table(spark, d, "customer").select(
        k.alias("k"), F.col("c_nationkey").alias("state"), F.when(k % 29 != 0, F.floor(F.col("c_acctbal") * (k % 40))).alias("workers"), F.when(k % 3 != 0, pct(k % 50, k % 47 + 50)).alias("gender"), pct(k % 13 + 40, F.when(k % 5 != 0, 50)).alias("race"),
        pct(F.lit(20), k % 11 + 74).alias("hispanic"), F.when(k % 4 == 0, pct(k % 7 + 94)).otherwise(F.array().cast("array<double>")).alias("age"), pct(k % 9 * 10.5, 100 - k % 9 * 10).alias("education"),
    )
    employed = table(spark, d, "customer").where("c_nationkey % 8 <> 3").groupBy(F.col("c_nationkey").alias("st")).agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / 2).alias("employed"))
    j = c.join(employed, F.col("state") == F.col("st"), "left")
    told = sc.implausible("workers", "employed", {"gender": "gender", "race": "race", "hispanic": "hispanic", "age_distribution": "age", "education": "education"})
    return j.select("k", F.array_join(told, "; ").alias("warnings"))


BOUNDS = """WITH e AS (SELECT c_nationkey st, sum(c_acctbal::DECIMAL(18,2))::DOUBLE / 2 em FROM customer WHERE c_nationkey % 8 <> 3 GROUP BY 1), c AS (SELECT c_custkey k, CASE WHEN c_custkey % 29 <> 0 THEN floor(c_acctbal * (c_custkey % 40)) END w, floor(coalesce(em, 144540000) * 1.30::DOUBLE) m FROM customer LEFT JOIN e ON c_nationkey = st)
SELECT k, concat_ws('; ', CASE WHEN w <= 0 THEN 'total_workers must be > 0' WHEN w > m THEN 'total_workers exceeds ceiling' END, CASE WHEN k % 3 <> 0 AND abs(k % 50 + k % 47 + 50 - 100) > 3 THEN 'gender pct sum outside' END, CASE WHEN abs(k % 13 + 40 + CASE WHEN k % 5 <> 0 THEN 50 ELSE 0 END - 100) > 3 THEN 'race pct sum outside' END,
CASE WHEN abs(20 + k % 11 + 74 - 100) > 3 THEN 'hispanic pct sum outside' END, CASE WHEN k % 4 = 0 AND abs(k % 7 + 94 - 100) > 3 THEN 'age_distribution pct sum outside' END, CASE WHEN (k % 9) * 0.5 > 3 THEN 'education pct sum outside' END) warnings FROM c"""


def hellinger_by_segment(spark, d):
    """Hellinger distance between the order statuses of each segment and of all customers."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    parts = [F.avg((F.col("o_orderstatus") == s).cast("double")) for s in ("F", "O", "P")]
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    whole = j.agg(*[p.alias(f"q{i}") for i, p in enumerate(parts)])
    per = j.groupBy("c_mktsegment").agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return per.join(F.broadcast(whole)).select("c_mktsegment", rounded(sc.hellinger(["p0", "p1", "p2"], ["q0", "q1", "q2"]), 6).alias("hellinger"))  # one row is broadcast


_SH = ", ".join(f"avg((o_orderstatus = '{s}')::INT::DOUBLE) {{0}}{i}" for i, s in enumerate("FOP"))
HELLINGER = f"WITH j AS (SELECT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey), q AS (SELECT {_SH.format('q')} FROM j), p AS (SELECT c_mktsegment, {_SH.format('p')} FROM j GROUP BY 1) SELECT c_mktsegment, {R('sqrt((sqrt(p0) - sqrt(q0)) ** 2 + (sqrt(p1) - sqrt(q1)) ** 2 + (sqrt(p2) - sqrt(q2)) ** 2) / sqrt(2.0::DOUBLE)', 6)} hellinger FROM p, q"


def richness_filter(spark, d):
    """Customers of whom at least 18 of 27 facts are known."""
    f = facts(spark, d)
    known = sum((F.col(c).isNotNull().cast("long") for c in FACTS), F.lit(0).cast("long"))
    return f.select("k", known.alias("known")).where("known >= 18")


RICH = f"WITH {FACTS_SQL} SELECT k, known FROM (SELECT k, ({' + '.join(f'({c} IS NOT NULL)::BIGINT' for c in FACTS)})::BIGINT known FROM f) WHERE known >= 18"

SQL = {
    "factor_scores": f"WITH {FACTS_SQL}, {FACTOR} SELECT * EXCLUDE (nlrb, osha) FROM g", "research_enhanced": ENHANCED, "density_signals": DENSITY, "recommended_actions": ACTIONS, "party_employers": PARTY, "director_names": DIRECTORS,
    "score_eligible": ELIGIBLE, "demographic_bounds": BOUNDS, "hellinger_by_segment": HELLINGER, "richness_filter": RICH,
}
QUERIES = {name: globals()[name] for name in SQL}
