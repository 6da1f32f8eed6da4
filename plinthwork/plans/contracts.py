"""Contract queries over texts worded from orders, and the remaining relational forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions import similarity as sim
from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import contracts as ct
from plinthwork.operators import relational as rel
from plinthwork.plans.matching import GRAMS
from plinthwork.plans.scorecards import R

EMPLOYERS = ("Acme Steel", "Blue River Foods", "Cedar Mills", "Delta Glass")
#: Unions with the number of their local.
UNIONS = (("Teamsters Local 705", "705"), ("Carpenters District Council", None), ("United Workers Local No. 12", "12"), ("Machinists Lodge No. 7", "7"), ("Operating Engineers Local 100A", "100A"), ("Nurses Association", None))
DAYS = ("New Year", "Memorial Day", "Labor Day", "Thanksgiving", "Christmas", "Easter")
#: Texts that a task reads at most, about.
TEXTS = 10_000
_FILL = "Both sides keep their records in good order and hand them over when asked to do so, in full and without delay. " * 3


def _choose(k, items):
    """One of the texts by the key; null where the item is."""
    return F.get(F.array(*[F.lit(x) for x in items]), (k % len(items)).cast("int"))


def _contracts(spark, d):
    """Contract texts of orders: parties, dates, places, holidays, rates, steps and more, all worded by the key."""
    k = F.col("o_orderkey")
    e, u = _choose(k, EMPLOYERS), _choose(k, [n for n, _ in UNIONS])
    opening = _choose(k, ["a", "b", "c"])
    parts = [
        F.when(opening == "a", F.concat(F.lit("This Agreement is made by and between the "), e, F.lit(" and "), u, F.lit(", both of good standing. "))).when(opening == "b", F.concat(F.lit("Contract between the "), u, F.lit(' and "'), e, F.lit('", made in good faith. '))).otherwise(F.concat(F.lit("Entered into by "), e, F.lit(" and "), u, F.lit(", as follows. "))),
        F.when(k % 5 == 0, F.concat(F.lit("It is a "), (k % 12).cast("string"), F.lit("-year agreement. "))),
        _choose(k, ["It is effective as of January 1, 2022 and shall expire on December 31, 2025. ", "It holds for the period March 1, 2023 through February 28, 2027. ", "Effective 01/15/2024 and ending on 01/14/2028. ", "2021-2024 Master Agreement. "]),
        _choose(k, ["", "It covers shops in the state of New York. ", "Its seat is Albany, Ohio. ", "Its shops are located in West Virginia. "]),
        F.when(k % 5 == 2, "The bargaining unit shall consist of all maintenance workers and porters of the plants. "),
        F.when(k % 7 > 0, F.concat(F.lit("Holidays are "), F.array_join(F.slice(F.array(*[F.lit(x) for x in DAYS]), F.lit(1), (k % 7).cast("int")), ", "), F.when(k % 3 > 0, F.concat(F.lit(" and "), (k % 3).cast("string"), F.lit(" floating holidays"))).otherwise(""), F.lit(". "))),
        _choose(k, ["", "They are paid at double time and one half. ", "They are paid at time and a half. ", "They are paid at straight time. ", "They are paid at triple time. "]), F.lit(_FILL),
        F.when(k % 3 == 1, "Overtime is paid at time and one half. "),
        F.when(k % 6 == 1, "A 4-step grievance procedure applies. ").when(k % 6 > 1, F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest((k % 6).cast("int"), F.lit(1))), lambda i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": meet"))), "; "), F.lit(". "))),
        F.when(k % 2 == 1, "There is no strike during the term. "),
        _choose(k, ["The probation lasts sixty (60) calendar days. ", "Within 3 months of hire, probation is over. ", "A probation of 5 days is usual. ", ""]),
        F.when(k % 3 == 0, "Rates: $12.50, $13.75 and $14,00. "), F.when(k % 8 == 7, "Wages ........ 4"),
    ]
    orders = table(spark, d, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // TEXTS))
    # Dealt out once worded: else each field would word the text anew, and as the texts come from small files, few tasks would read them all.
    return orders.select("o_orderkey", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("text")).repartition(tasks, "o_orderkey")


def contract_fields(spark, d):
    """Parties, local, dates, state, unit, term, holidays, rates, steps, probation, marks and words of each order's contract text."""
    t = F.col("text")
    j = _contracts(spark, d).withColumn("p", ct.parties(t)).withColumn("s", ct.section_facts(t)).withColumn("w", ct.contract_dates(t))
    return j.select(
        "o_orderkey", "p.employer", F.col("p.union").alias("other"), ct.local_number(t).alias("local_number"), F.col("w.effective").alias("effective"), F.col("w.expires").alias("expires"), ct.place_state(t).alias("state"),
        ct.bargaining_unit(t).alias("unit"), ct.term_years(t).alias("years"), ct.holidays(t).alias("holidays"), ct.holiday_rate(t).alias("holiday_rate"), ct.overtime_rate(t).alias("overtime_rate"), ct.grievance_steps(t).alias("steps"),
        ct.no_strike(t).alias("no_strike"), ct.probation_days(t).alias("probation"), ct.kept_chunk(t, F.lit(3), F.lit(40)).alias("stays"), F.col("s.words").alias("words"), F.col("s.wage_table").alias("wage_table"),
    )


def _v(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _pick(items, k="k"):
    return "[" + ", ".join(_v(x) for x in items) + f"][{k} % {len(items)} + 1]"


_WORDS = {"filler": len(_FILL.split())}
FIELDS = f"""WITH t AS (SELECT o_orderkey k, {_pick(EMPLOYERS, "o_orderkey")} e, {_pick([n for n, _ in UNIONS], "o_orderkey")} u FROM orders), n AS (SELECT *, len(string_split(e, ' ')) ew, len(string_split(u, ' ')) uw FROM t)
SELECT k o_orderkey, e employer, CASE WHEN k % 3 = 1 THEN u ELSE string_split(u, '.')[1] END other, {_pick([x for _, x in UNIONS])} local_number,
{_pick(["January 1, 2022", "March 1, 2023", "01/15/2024", "January 1, 2021"])} effective, {_pick(["December 31, 2025", "February 28, 2027", "01/14/2028", "December 31, 2024"])} expires, {_pick([None, "New York", "Ohio", "West Virginia"])} state,
CASE WHEN k % 5 = 2 THEN 'of all maintenance workers and porters of the plants' END unit, (CASE WHEN k % 5 = 0 AND k % 12 BETWEEN 1 AND 10 THEN k % 12 WHEN k % 4 < 2 THEN 4 END)::INTEGER AS years, (CASE WHEN k % 7 >= 3 THEN k % 7 + k % 3 END)::INTEGER AS holidays,
CASE k % 5 WHEN 1 THEN '2.5' WHEN 4 THEN '3.0' WHEN 2 THEN '1.5' WHEN 3 THEN CASE WHEN k % 3 = 1 THEN '1.5' ELSE '1.0' END ELSE CASE WHEN k % 3 = 1 THEN '1.5' END END holiday_rate, CASE WHEN k % 3 = 1 THEN '1.5' END overtime_rate,
(CASE WHEN k % 6 = 1 THEN 4 WHEN k % 6 > 1 THEN k % 6 END)::INTEGER steps, k % 2 = 1 no_strike, (CASE k % 4 WHEN 0 THEN 60 WHEN 1 THEN 90 END)::INTEGER probation, k % 8 <> 7 stays,
(CASE k % 3 WHEN 0 THEN 13 + ew + uw WHEN 1 THEN 8 + ew + uw ELSE 6 + ew + uw END + CASE WHEN k % 5 = 0 THEN 5 ELSE 0 END + [15, 12, 6, 3][k % 4 + 1] + [0, 9, 5, 7][k % 4 + 1] + CASE WHEN k % 5 = 2 THEN 14 ELSE 0 END
+ CASE WHEN k % 7 > 0 THEN 2 + [2, 4, 6, 7, 8, 9][k % 7] + CASE WHEN k % 3 > 0 THEN 4 ELSE 0 END ELSE 0 END + [0, 9, 8, 6, 6][k % 5 + 1] + {_WORDS["filler"]} + CASE WHEN k % 3 = 1 THEN 8 ELSE 0 END
+ CASE WHEN k % 6 = 1 THEN 5 WHEN k % 6 > 1 THEN 3 * (k % 6) ELSE 0 END + CASE WHEN k % 2 = 1 THEN 7 ELSE 0 END + [7, 8, 7, 0][k % 4 + 1] + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 8 = 7 THEN 3 ELSE 0 END)::BIGINT words, k % 3 = 0 wage_table FROM n"""


def address_match(spark, d):
    """Customers and suppliers of one street number, city and state whose names are similar at 0.4 or more, the best each."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("state"), (F.col("c_custkey") % 20).alias("city"), (F.col("c_custkey") % 90 + 1).alias("street_no"), F.concat(F.lit("company "), F.lower("c_name")).alias("x"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("state"), (F.col("s_suppkey") % 20).alias("city"), (F.col("s_suppkey") % 90 + 1).alias("street_no"), F.concat(F.lit("company "), F.lower("s_name")).alias("y"))
    c, s = (side.withColumn(n, sim.trigrams(n)).repartition("state", "city", "street_no") for side, n in ((c, "x"), (s, "y")))  # grams once a name
    j = c.join(s, ["state", "city", "street_no"]).withColumn("similarity", rounded(sim.jaccard("x", "y"))).where("similarity >= 0.4")
    return rel.first_by(j, ["c_custkey"], [F.desc("similarity"), F.asc("s_suppkey")]).select("c_custkey", "s_suppkey", "similarity")


_X, _Y = GRAMS.format(x="x"), GRAMS.format(x="y")
ADDRESS = f"""WITH j AS (SELECT c_custkey, s_suppkey, 'company ' || lower(c_name) x, 'company ' || lower(s_name) y FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 20 = s_suppkey % 20 AND c_custkey % 90 = s_suppkey % 90), g AS (SELECT c_custkey, s_suppkey, {_X} p, {_Y} q FROM j),
s AS (SELECT c_custkey, s_suppkey, {R("len(list_intersect(p, q))::DOUBLE / (len(p) + len(q) - len(list_intersect(p, q)))")} similarity FROM g) SELECT DISTINCT ON (c_custkey) c_custkey, s_suppkey, similarity FROM s WHERE similarity >= 0.4 ORDER BY c_custkey, similarity DESC, s_suppkey"""


def bridge_join(spark, d):
    """Customers and the suppliers they reach through the master of orders: source to master to other source."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("o_custkey", "l_suppkey").agg(F.count_distinct("o_orderkey").alias("orders"))


BRIDGE = "SELECT o_custkey, l_suppkey, count(DISTINCT o_orderkey) orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def update_from(spark, d):
    """Customers with the balance that their latest order sets, or their own: an update as a left join."""
    o = rel.first_by(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("new"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("double").alias("old"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("new", "old").alias("balance"), F.col("new").isNotNull().alias("updated"))


UPDATE = "WITH o AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS new FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) SELECT c_custkey, coalesce(new, c_acctbal::DECIMAL(18,2)::DOUBLE) balance, new IS NOT NULL updated FROM customer LEFT JOIN o ON c_custkey = o_custkey"


def keyset_page(spark, d):
    """The hundred orders after a given (date, key): a page that resumes where the last one ended."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    at, key = F.to_date(F.lit("1996-01-01")), F.lit(1000)
    return o.where((F.col("day") > at) | ((F.col("day") == at) & (F.col("o_orderkey") > key))).orderBy("day", "o_orderkey").limit(100).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "o_orderkey")


KEYSET = "SELECT strftime(o_orderdate::DATE, '%Y-%m-%d') AS day, o_orderkey FROM orders WHERE (o_orderdate::DATE, o_orderkey) > (DATE '1996-01-01', 1000) ORDER BY o_orderdate::DATE, o_orderkey LIMIT 100"


def cube_counts(spark, d):
    """Orders by status and priority with all subtotals; nulls of the data and of subtotals are told apart by ``level``."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


CUBE = "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


def alias_boost(spark, d):
    """Parts ranked for an alias: rows of a canonical pattern first, excluded terms left out, then similarity."""
    alias = [("bolt", "small bolt", "red")]
    a = spark.createDataFrame(alias, "alias string, canonical string, excluded string")
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    j = p.join(F.broadcast(a), F.contains(F.col("name"), F.col("alias")) & ~F.contains(F.col("name"), F.col("excluded")))  # a configured list
    j = j.withColumn("boost", F.contains("name", "canonical").cast("int")).withColumn("similarity", rounded(sim.trigram_similarity("alias", "name")))
    return j.orderBy(F.desc("boost"), F.desc("similarity"), "p_partkey").limit(50).select("p_partkey", "boost", "similarity")


_A, _N = GRAMS.format(x="'bolt'"), GRAMS.format(x="p_name")
BOOST = f"WITH p AS (SELECT p_partkey, contains(lower(p_name), 'small bolt')::INT boost, {_A} x, {_N} y FROM part WHERE contains(lower(p_name), 'bolt') AND NOT contains(lower(p_name), 'red')) SELECT p_partkey, boost, {R('len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y)))')} similarity FROM p ORDER BY boost DESC, similarity DESC, p_partkey LIMIT 50"


def match_quality(spark, d):
    """Matches by method and band with their share of all and of those accepted."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.when(F.col("o_totalprice") > 200000, "HIGH").when(F.col("o_totalprice") > 100000, "MEDIUM").otherwise("LOW").alias("band"))
    g = o.groupBy("method", "band").agg(F.count(F.lit(1)).alias("n"))
    whole = o.groupBy("method").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("band") != "LOW").alias("accepted"))
    return g.join(whole, "method").select("method", "band", "n", rounded(F.col("n") / F.col("all")).alias("share"), rounded(F.col("accepted") / F.col("all")).alias("accepted"))


QUALITY = f"WITH o AS (SELECT o_orderpriority AS method, CASE WHEN o_totalprice > 200000 THEN 'HIGH' WHEN o_totalprice > 100000 THEN 'MEDIUM' ELSE 'LOW' END band FROM orders), g AS (SELECT method, band, count(*) n FROM o GROUP BY 1, 2), w AS (SELECT method, count(*) a, count(*) FILTER (band <> 'LOW') k FROM o GROUP BY 1) SELECT method, band, n, {R('n::DOUBLE / a')} AS share, {R('k::DOUBLE / a')} accepted FROM g JOIN w USING (method)"

SQL = {"contract_fields": FIELDS, "address_match": ADDRESS, "bridge_join": BRIDGE, "update_from": UPDATE, "keyset_page": KEYSET, "cube_counts": CUBE, "alias_boost": BOOST, "match_quality": QUALITY}
QUERIES = {name: globals()[name] for name in SQL}
