"""Family roll-ups, industry inference, de-duplicated memberships, holders, and seeding of master records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import relational as rel
from plinthwork.plans.scorecards import R

MONEY = "decimal(18,2)"


def family_rollup(spark, d):
    """Sales of families by name stem (the last word of a part's name), with their suppliers and years."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    sold = l.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("v"), F.count(F.lit(1)).alias("n"), F.min(F.year("l_shipdate")).alias("y0"), F.max(F.year("l_shipdate")).alias("y1"))
    j = p.withColumn("stem", F.lower(F.substring_index("p_name", " ", -1))).join(sold, p["p_partkey"] == sold["l_partkey"], "left")
    return j.groupBy("stem").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("sales"), F.sum("n").cast("long").alias("cases"), F.min("y0").cast("long").alias("first_year"), F.max("y1").cast("long").alias("last_year"), F.count_distinct("p_brand").alias("brands"))


FAMILY = """WITH s AS (SELECT l_partkey, sum(l_extendedprice::DECIMAL(18,2)) v, count(*) n, min(year(l_shipdate)) y0, max(year(l_shipdate)) y1 FROM lineitem GROUP BY 1)
SELECT lower(string_split(p_name, ' ')[-1]) stem, count(*) members, coalesce(sum(v), 0)::DOUBLE sales, sum(n)::BIGINT cases, min(y0)::BIGINT first_year, max(y1)::BIGINT last_year, count(DISTINCT p_brand) brands FROM part LEFT JOIN s ON p_partkey = l_partkey GROUP BY 1"""

KEYWORDS = [(r"\b(ring|bolt|nut)\b", "33"), (r"\b(widget|gear)\b", "31"), (r"\b(plate|panel)\b", "32")]


def industry_inference(spark, d):
    """Code of a part: its own type's, else by keyword, else what most parts of its brand have."""
    p = table(spark, d, "part")
    own = F.when(F.col("p_size") % 3 == 0, F.lpad((F.length("p_type") % 5 + 40).cast("string"), 2, "0"))
    word = F.lit(None).cast("string")
    for pattern, code in reversed(KEYWORDS):
        word = F.when(F.lower("p_name").rlike(pattern), code).otherwise(word)
    base = p.select("p_partkey", "p_brand", own.alias("own"), word.alias("word"))
    votes = base.where("own is not null").groupBy("p_brand", "own").agg(F.count(F.lit(1)).alias("n"))
    mode = rel.first_by(votes, ["p_brand"], [F.desc("n"), F.desc("own")]).select(F.col("p_brand").alias("b"), F.col("own").alias("vote"))
    j = base.join(mode, base["p_brand"] == mode["b"], "left")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("word").isNotNull(), "keyword").when(F.col("vote").isNotNull(), "vote")
    return j.select("p_partkey", F.coalesce("own", "word", "vote").alias("code"), how.alias("how"))


INDUSTRY = "WITH b AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN lpad((length(p_type) % 5 + 40)::VARCHAR, 2, '0') END own, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{p}') THEN '{c}'" for p, c in KEYWORDS) + " END word FROM part), v AS (SELECT p_brand, own, count(*) n FROM b WHERE own IS NOT NULL GROUP BY 1, 2), m AS (SELECT DISTINCT ON (p_brand) p_brand, own vote FROM v ORDER BY p_brand, n DESC, own DESC) SELECT p_partkey, coalesce(own, word, vote) code, CASE WHEN own IS NOT NULL THEN 'own' WHEN word IS NOT NULL THEN 'keyword' WHEN vote IS NOT NULL THEN 'vote' END how FROM b LEFT JOIN m USING (p_brand)"


def membership_dedup(spark, d):
    """Customers counted once by nation and balance, against the raw count, and the ratio by region."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    first = c.withColumn("counted", F.row_number().over(rel.Window.partitionBy("c_nationkey", F.round(F.col("c_acctbal") / 500)).orderBy("c_custkey")) == 1)
    j = first.join(n, first["c_nationkey"] == n["n_nationkey"])
    g = j.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("counted").alias("counted"))
    return g.withColumn("ratio", rounded(F.col("counted") / F.col("raw")))


MEMBERS = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, round(c_acctbal / 500) ORDER BY c_custkey) = 1 k FROM customer), g AS (SELECT n_regionkey::BIGINT region, count(*) raw, count(*) FILTER (k) counted FROM f JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT *, {R("counted::DOUBLE / raw")} ratio FROM g"""


def latest_holders(spark, d):
    """Holders of a priority class: each customer's latest order of a year that has one, summed by class."""
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    has = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "year").distinct()
    last = rel.first_by(o.join(has, ["o_custkey", "year"], "left_semi"), ["o_custkey", "year"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.groupBy("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("holders"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("value"))


HOLDERS = """WITH o AS (SELECT *, year(o_orderdate) y FROM orders), l AS (SELECT DISTINCT ON (o_custkey, y) * FROM o WHERE EXISTS (SELECT 1 FROM o u WHERE u.o_custkey = o.o_custkey AND u.y = o.y AND u.o_orderpriority = '1-URGENT') ORDER BY o_custkey, y, o_orderdate DESC, o_orderkey DESC)
SELECT y::BIGINT AS year, o_orderstatus, count(*) holders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM l GROUP BY 1, 2"""


def seed_masters(spark, d):
    """Suppliers attached to customers' masters by nation and rounded balance, the rest inserted as new ones."""
    key = lambda k, v: (F.col(k).cast("long").alias("nation"), F.floor(F.col(v) / 100).alias("bin"))
    masters = table(spark, d, "customer").select("c_custkey", *key("c_nationkey", "c_acctbal"))
    per = masters.groupBy("nation", "bin").agg(F.min("c_custkey").alias("master"))
    s = table(spark, d, "supplier").select("s_suppkey", *key("s_nationkey", "s_acctbal"))
    linked = s.join(per, ["nation", "bin"]).select("s_suppkey", "master", F.lit("linked").alias("how"), F.lit(0.9).alias("confidence"))
    new = s.join(per, ["nation", "bin"], "left_anti").select("s_suppkey", (-F.col("s_suppkey")).alias("master"), F.lit("new").alias("how"), F.lit(0.7).alias("confidence"))
    return linked.unionByName(new)


SEED = """WITH p AS (SELECT c_nationkey n, floor(c_acctbal / 100) b, min(c_custkey) AS m FROM customer GROUP BY 1, 2) SELECT s_suppkey, coalesce(m, -s_suppkey) AS master, CASE WHEN m IS NULL THEN 'new' ELSE 'linked' END how, CASE WHEN m IS NULL THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END confidence FROM supplier LEFT JOIN p ON n = s_nationkey AND b = floor(s_acctbal / 100)"""

SQL = {"family_rollup": FAMILY, "industry_inference": INDUSTRY, "membership_dedup": MEMBERS, "latest_holders": HOLDERS, "seed_masters": SEED}
QUERIES = {name: globals()[name] for name in SQL}
