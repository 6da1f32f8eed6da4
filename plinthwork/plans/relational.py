"""The relational surface: joins, aggregation, windows, set operations, paging, over the public tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import relational as rel
from plinthwork.plans.scorecards import AS_OF, R

MONEY = "decimal(18,2)"


def full_outer_activity(spark, d):
    """Returns and open orders of a year, by whichever side has the customer."""
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders")
    returned = o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy(F.col("o_custkey").alias("a")).agg(F.sum("n").alias("returned"))
    pending = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("b")).agg(F.count(F.lit(1)).alias("pending"))
    return returned.join(pending, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("custkey"), "returned", "pending")


def cascade_lookup(spark, d):
    """Average price of the longest known type prefix: 12, then 6 characters, then all."""
    p = table(spark, d, "part")
    price = F.col("p_retailprice").cast(MONEY)
    long = p.groupBy(F.substring("p_type", 1, 12).alias("prefix")).agg(F.avg(price).alias("average"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    short = p.groupBy(F.substring("p_type", 1, 4).alias("prefix")).agg(F.avg(price).alias("average"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    every = p.agg(F.avg(price).alias("average")).select(F.lit("ALL").alias("prefix"), "average", F.lit(0).alias("n"))
    lookup = long.unionByName(short).unionByName(every).groupBy("prefix").agg(F.max(F.col("average").cast("double")).alias("average"))
    out = rel.prefix_cascade(p.select("p_partkey", "p_type"), "p_type", lookup, "prefix", "average", [12, 4], "ALL")
    return out.select("p_partkey", rounded("average", 2).alias("average"), F.col("matched_length").cast("long").alias("matched_length"))


CASCADE = f"""WITH l AS (SELECT prefix, max(a) a FROM (SELECT left(p_type, 12) prefix, avg(p_retailprice::DECIMAL(18,2)) a FROM part GROUP BY 1 HAVING count(*) >= 20 UNION ALL SELECT left(p_type, 4), avg(p_retailprice::DECIMAL(18,2)) FROM part GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1), t AS (SELECT avg(p_retailprice::DECIMAL(18,2)) a FROM part)
SELECT p_partkey, {R("coalesce(x.a, y.a, t.a)", 2)} average, (CASE WHEN x.a IS NOT NULL THEN 12 WHEN y.a IS NOT NULL THEN 4 ELSE 0 END)::BIGINT matched_length FROM part CROSS JOIN t LEFT JOIN l x ON x.prefix = left(p_type, 12) LEFT JOIN l y ON y.prefix = left(p_type, 4)"""


def lateral_best_row(spark, d):
    """For each part the best supplier row: most returned lines, then cheapest, then key."""
    l = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.min("l_extendedprice").alias("cheapest"))
    best = rel.first_by(l, ["l_partkey"], [F.desc("returns"), F.asc("cheapest"), F.asc("l_suppkey")])
    return table(spark, d, "part").join(best, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l_suppkey", "returns", "cheapest")


def range_bucket_rates(spark, d):
    """Share of won orders by price interval, through a cell join on interval bounds."""
    bounds = spark.createDataFrame([("tiny", 0.0, 20000.0), ("small", 20000.0, 80000.0), ("medium", 80000.0, 200000.0), ("large", 200000.0, 1000000.0)], "bucket string, low double, high double")
    o = table(spark, d, "orders").select("o_totalprice", "o_orderstatus")
    j = rel.interval_join(o, "o_totalprice", bounds, "low", "high", 20000.0)
    return j.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), rounded(F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("win_rate"))


def hyphen_range_join(spark, d):
    """Sectors written as hyphen ranges ('31-33') joined to codes by spreading each range over its codes."""
    sectors = spark.createDataFrame([("1-10", "small"), ("11-25", "middle"), ("26-40", "large"), ("41-50", "huge")], "span string, sector string")
    codes = sectors.select("sector", F.explode(F.sequence(F.split_part("span", F.lit("-"), F.lit(1)).cast("int"), F.split_part("span", F.lit("-"), F.lit(2)).cast("int"))).alias("code"))
    p = table(spark, d, "part")
    return p.join(codes, p["p_size"] == codes["code"]).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_retailprice").cast(MONEY)).cast("double").alias("value"))


def semi_anti_pack(spark, d):
    """Customers by EXISTS and NOT EXISTS on orders of two kinds."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    won = o.where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_custkey")
    big = o.where("o_totalprice > 450000").select("o_custkey")
    return c.join(won, c["c_custkey"] == won["o_custkey"], "left_semi").join(big, F.col("c_custkey") == big["o_custkey"], "left_anti").select("c_custkey", "c_name")


def state_industry_grid(spark, d):
    """Every region by segment (a cross of two reference lists) with its count, zero where there is none."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    segments = c.select("c_mktsegment").distinct()
    grid = r.select("r_regionkey", "r_name").crossJoin(F.broadcast(segments))  # 5 regions by the distinct segments
    have = c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_regionkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("c_acctbal").cast(MONEY)).cast("double").alias("average"))
    return grid.join(have, (grid["r_regionkey"] == have["k"]) & (grid["c_mktsegment"] == have["s"]), "left").select("r_name", "c_mktsegment", F.coalesce("n", F.lit(0)).cast("long").alias("n"), rounded("average", 2).alias("average"))


def latest_per_key(spark, d):
    """Last event of each user and type, and what a user last bought before it."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    last = rel.first_by(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("bought_at")).agg(F.max("value").alias("bought"))
    out = rel.as_of_join(last, bought, ["user_id"], "ts", "bought_at", ["bought"])
    return out.select("user_id", "event_type", "event_id", rounded("value").alias("value"), rounded("bought").alias("bought"))


LATEST = f"""WITH l AS (SELECT DISTINCT ON (user_id, event_type) * FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC), b AS (SELECT user_id, ts, max(value) v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT l.user_id, event_type, event_id, {R("l.value")} AS value, {R("b.v")} bought FROM l ASOF LEFT JOIN b ON l.user_id = b.user_id AND l.ts >= b.ts"""


def density_cube(spark, d):
    """Weighted share of won orders by nation and segment, and by nation alone; thin cells are flagged."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("n_name", "c_mktsegment", F.col("o_totalprice").cast(MONEY).alias("w"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("m"))
    g = j.groupingSets([["n_name", "c_mktsegment"], ["n_name"]], "n_name", "c_mktsegment").agg(F.grouping("c_mktsegment").alias("g"), F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("m")).cast("double").alias("top"), F.sum("w").cast("double").alias("bottom"))
    return g.select("n_name", F.when(F.col("g") == 1, "all").otherwise(F.col("c_mktsegment")).alias("sector"), "n", rounded(F.col("top") / F.col("bottom") * 100, 2).alias("density"), (F.col("n") < 30).alias("unreliable"))


DENSITY = f"""WITH j AS (SELECT n_name, c_mktsegment, o_totalprice::DECIMAL(18,2) w, (o_orderstatus = 'F')::INT m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT n_name, CASE WHEN grouping(c_mktsegment) = 1 THEN 'all' ELSE c_mktsegment END sector, count(*) n, {R("sum(w * m)::DOUBLE / sum(w)::DOUBLE * 100", 2)} density, count(*) < 30 unreliable FROM j GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name))"""


def argmax_stringagg_percentile(spark, d):
    """Arg-max, ordered string and array aggregates, JSON, percentiles, deviation and FILTER by priority."""
    o = table(spark, d, "orders").select("*", F.col("o_totalprice").cast(MONEY).alias("v"))
    best = F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey"))
    return o.groupBy("o_orderpriority").agg(
        best.alias("dearest"), F.array_sort(F.collect_set("o_orderstatus")).alias("kinds"), F.percentile("o_totalprice", F.lit(0.5)).alias("p50"), F.percentile("o_totalprice", F.lit(0.9)).alias("p90"),
        F.stddev_samp("o_totalprice").alias("sd"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("winners"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).cast("date").alias("first_open"), F.sum("v").cast("double").alias("total"),
    ).select("o_orderpriority", "dearest", F.array_join("kinds", ",").alias("kinds"), rounded("p50", 2).alias("p50"), rounded("p90", 2).alias("p90"), rounded("sd", 2).alias("sd"), "winners", F.col("first_open").cast("string").alias("first_open"), "total", F.to_json(F.struct(F.size("kinds").alias("n"), F.col("o_orderpriority").alias("p"))).alias("doc"))


ARGMAX = f"""SELECT o_orderpriority, arg_max(o_orderkey, {{'a': o_totalprice, 'b': o_orderkey}}) dearest, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) kinds, {R("quantile_cont(o_totalprice, 0.5)", 2)} p50, {R("quantile_cont(o_totalprice, 0.9)", 2)} p90, {R("stddev_samp(o_totalprice)", 2)} sd, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') winners, (min(o_orderdate) FILTER (o_orderstatus = 'O'))::DATE::VARCHAR first_open, sum(o_totalprice::DECIMAL(18,2))::DOUBLE total, '{{"n":' || count(DISTINCT o_orderstatus) || ',"p":"' || o_orderpriority || '"}}' doc FROM orders GROUP BY 1"""


def yoy_jump(spark, d):
    """Orders of a segment by year with the year before, flagged at a change of half or more."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    y = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("c_mktsegment").orderBy("year"))
    return y.withColumn("before", before).withColumn("jump", F.coalesce(F.abs(F.col("n") - F.col("before")) >= F.col("before") * 0.5, F.lit(False)))


YOY = """WITH y AS (SELECT c_mktsegment, year(o_orderdate) AS year, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT *, lag(n) OVER (PARTITION BY c_mktsegment ORDER BY year) AS before FROM y)
SELECT *, coalesce(abs(n - before) >= before * 0.5, false) jump FROM b"""


def minmax_features(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.log1p(F.abs("c_acctbal")).alias("size"), F.col("c_nationkey").cast("double").alias("place"))
    return rel.min_max(c, ["size", "place"]).select("c_custkey", rounded("size_scaled").alias("size_scaled"), rounded("place_scaled").alias("place_scaled"))


def union_all_search_index(spark, d):
    """Three sources under one schema, tagged, one row a name, the preferred source first."""
    c, s, p = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "part")
    parts = [
        c.select(F.lower("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.lit(1).alias("preference"), F.col("c_acctbal").alias("size")),
        s.select(F.lower("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.lit(2).alias("preference"), F.col("s_acctbal").alias("size")),
        p.where("p_retailprice >= 1000").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("id"), F.lit("part").alias("source"), F.lit(3).alias("preference")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return rel.first_by(every, ["name"], [F.asc("preference"), F.asc("id")]).select("name", "id", "source", "size")


SEARCH = """SELECT name, id, source, size FROM (SELECT DISTINCT ON (name) * FROM (SELECT lower(c_name) AS name, c_custkey id, 'customer' source, 1 pref, c_acctbal size FROM customer UNION ALL SELECT lower(s_name), s_suppkey, 'supplier', 2, s_acctbal FROM supplier UNION ALL SELECT lower(p_name), p_partkey, 'part', 3, NULL FROM part WHERE p_retailprice >= 1000) ORDER BY name, pref, id)"""


def run_diff(spark, d):
    """Two matching runs (orders of odd and of later keys as one) compared key by key."""
    o = table(spark, d, "orders")
    runs = [o.where(p).groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("value"), F.max("o_totalprice").alias("score")) for p in ("o_orderdate < '1999-01-01'", "o_orderdate >= '1997-01-01'")]
    return rel.run_diff(runs[0], runs[1], "o_custkey", "value", "score")


RUN_DIFF = """WITH a AS (SELECT o_custkey, arg_max(o_orderpriority, {'a': o_totalprice, 'b': o_orderkey}) v, max(o_totalprice) s FROM orders WHERE o_orderdate < DATE '1999-01-01' GROUP BY 1), b AS (SELECT o_custkey, arg_max(o_orderpriority, {'a': o_totalprice, 'b': o_orderkey}) v, max(o_totalprice) s FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) o_custkey, a.v old_value, a.s old_score, b.v new_value, b.s new_score, CASE WHEN a.v IS NULL THEN 'NEW' WHEN b.v IS NULL THEN 'LOST' WHEN a.v <> b.v THEN 'CHANGED' WHEN b.s > a.s THEN 'IMPROVED' WHEN b.s < a.s THEN 'DEGRADED' ELSE 'SAME' END change FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey"""


def json_props_filter(spark, d):
    """Filters and sums on a JSON property, and its keys as rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").where(k.isNotNull() & (k % 2 == 0)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(F.json_array_length(F.concat(F.lit("["), "props", F.lit("]")))).cast("long").alias("documents"))


def paged_list(spark, d):
    """Optional filters, a sort with nulls last and a unique end, one page, and the total beside each row."""
    given = {"segment": "BUILDING", "least": 1000.0, "nation": None}
    allowed = {"segment": lambda v: F.col("c_mktsegment") == v, "least": lambda v: F.col("c_acctbal") >= v, "nation": lambda v: F.col("c_nationkey") == v}
    rows = rel.filters(table(spark, d, "customer"), given, allowed)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rel.page(rows, [F.col("c_acctbal").desc_nulls_last(), F.asc("c_custkey")], 20, 25).select("c_custkey", "c_name", "c_acctbal").join(F.broadcast(total))


PAGED = """SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000) total FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 20"""


def predicates_pack(spark, d):
    """Between, lists, patterns, regular expressions and null-safe comparison in one filter."""
    p = table(spark, d, "part")
    keep = F.col("p_size").between(5, 45) & ~F.col("p_brand").isin("Brand#11") & (F.col("p_name").ilike("%ring%") | F.col("p_name").rlike(r"\bwidget\b") | F.col("p_type").like("%BRASS%") | F.col("p_name").rlike("^[a-m]")) & ~F.col("p_brand").eqNullSafe("Brand#12")
    return p.where(keep).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_name"))


PREDICATES = r"""SELECT p_brand, count(*) n, min(p_name) first_name FROM part WHERE p_size BETWEEN 5 AND 45 AND p_brand NOT IN ('Brand#11') AND (p_name ILIKE '%ring%' OR regexp_matches(p_name, '\bwidget\b') OR p_type LIKE '%BRASS%' OR regexp_matches(p_name, '^[a-m]')) AND p_brand IS DISTINCT FROM 'Brand#12' GROUP BY 1"""


def market_share(spark, d):
    """Share of all and rank among groups, over aggregated rows."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    g = l.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("v")).join(s, F.col("l_suppkey") == s["s_suppkey"]).groupBy("s_nationkey").agg(F.sum("v").alias("v"))
    w = Window.orderBy(F.desc("v"), F.asc("s_nationkey"))
    return g.select(F.col("s_nationkey").cast("long").alias("nation"), rounded(F.col("v").cast("double") / F.sum("v").over(Window.partitionBy()).cast("double") * 100).alias("share"), F.rank().over(w).cast("long").alias("place"), F.dense_rank().over(Window.orderBy(F.desc("v"))).cast("long").alias("dense"))


SHARE = f"""WITH g AS (SELECT s_nationkey, sum(l_extendedprice::DECIMAL(18,2)) v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT s_nationkey::BIGINT nation, {R("v::DOUBLE / (sum(v) OVER ())::DOUBLE * 100")} share, rank() OVER (ORDER BY v DESC, s_nationkey) place, dense_rank() OVER (ORDER BY v DESC) dense FROM g"""


def two_level_max_sum(spark, d):
    """Consolidated size: the largest order of each priority a customer has, summed."""
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.col("o_totalprice").cast(MONEY)).alias("m"))
    return o.groupBy("o_custkey").agg(F.sum("m").cast("double").alias("consolidated"), F.count(F.lit(1)).alias("kinds"))


def mode_winner(spark, d):
    """Most frequent status of a customer, then the longest, then the first by letter."""
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rel.first_by(o, ["o_custkey"], [F.desc("n"), F.desc(F.length("o_orderpriority")), F.asc("o_orderpriority")])


MODE = """SELECT DISTINCT ON (o_custkey) * FROM (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY 1, 2) ORDER BY o_custkey, n DESC, length(o_orderpriority) DESC, o_orderpriority"""


def upsert_latest(spark, d):
    """Nightly delta: changed orders replace older rows of their customer and day, new ones are added."""
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    current = rel.first_by(o.where("o_orderkey % 3 <> 0"), ["o_custkey", "day"], [F.desc("o_orderkey")])
    change = rel.first_by(o.where("o_orderkey % 3 = 0"), ["o_custkey", "day"], [F.desc("o_orderkey")])
    return rel.upsert(current, change, ["o_custkey", "day"], "o_orderkey").select("o_custkey", F.col("day").cast("string").alias("day"), "o_orderkey", "o_totalprice")


UPSERT = """SELECT o_custkey, day::VARCHAR AS day, o_orderkey, o_totalprice FROM (SELECT DISTINCT ON (o_custkey, day) * FROM (SELECT o_custkey, o_orderdate::DATE AS day, o_orderkey, o_totalprice FROM orders) ORDER BY o_custkey, day, o_orderkey DESC)"""


def stratified_sample(spark, d):
    """Ten customers a segment, by a hash order that every run repeats; shares by quota."""
    c = table(spark, d, "customer").withColumn("h", F.md5(F.concat(F.lit("s"), F.col("c_custkey").cast("string"))))
    return rel.top_k_by(c, ["c_mktsegment"], [F.asc("h"), F.asc("c_custkey")], 10, "place").select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


def window_pack(spark, d):
    """Partition counts and bounds beside each row, running totals and shares."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey")
    run = w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("o_totalprice").cast(MONEY)
    return o.select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"), F.min("o_totalprice").over(w).alias("low"), F.max("o_totalprice").over(w).alias("high"), F.sum(v).over(run).cast("double").alias("running"), F.ntile(4).over(w.orderBy("o_totalprice", "o_orderkey")).cast("long").alias("quarter"))


def set_operations(spark, d):
    """Keys in both, in one, and in either of two yearly lists."""
    o = table(spark, d, "orders")
    a, b = (o.where(F.year("o_orderdate") == y).select("o_custkey") for y in (1996, 1997))
    parts = [a.intersect(b).withColumn("kind", F.lit("both")), a.exceptAll(b).distinct().withColumn("kind", F.lit("first")), a.union(b).distinct().withColumn("kind", F.lit("either"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


SETS = """WITH a AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997), u AS (SELECT o_custkey, 'both' kind FROM (FROM a INTERSECT FROM b) UNION ALL SELECT DISTINCT o_custkey, 'first' FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT o_custkey, 'either' FROM (FROM a UNION FROM b))
SELECT kind, count(*) n, sum(o_custkey)::BIGINT keys FROM u GROUP BY 1"""


def freshness(spark, d):
    """Rows and date bounds of each dated source."""
    parts = []
    for name, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        parts.append(table(spark, d, name).agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min(c)).cast("string").alias("oldest"), F.to_date(F.max(c)).cast("string").alias("newest")).withColumn("source", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("late", F.col("newest") < F.lit(AS_OF))


def trailing_windows(spark, d):
    """Sums over the last two, three and five years before the date, in one pass."""
    o, day = table(spark, d, "orders"), F.to_date("o_orderdate")
    v = F.col("o_totalprice").cast(MONEY)
    return o.groupBy("o_custkey").agg(*[F.coalesce(F.sum(F.when(day >= F.to_date(F.lit(AS_OF)) - F.expr(f"INTERVAL {y} YEARS"), v)), F.lit(0)).cast("double").alias(f"y{y}") for y in (2, 3, 5)])


def distinct_counts(spark, d):
    """Rows, distinct values and nulls by column, for one table: the completeness report."""
    p = table(spark, d, "part")
    parts = [p.agg(F.lit(c).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("kinds"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in ("p_name", "p_brand", "p_type", "p_size")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_MONEY_SUM = "sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderdate::DATE >= DATE '{a}' - INTERVAL {y} YEARS)"
SQL = {
    "full_outer_activity": "WITH l AS (SELECT l_orderkey, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), r AS (SELECT o_custkey a, sum(n)::BIGINT returned FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1), p AS (SELECT o_custkey b, count(*) pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT coalesce(a, b) custkey, returned, pending FROM r FULL OUTER JOIN p ON a = b",
    "cascade_lookup": CASCADE,
    "lateral_best_row": "WITH g AS (SELECT l_partkey, l_suppkey, count(*) FILTER (l_returnflag = 'R') returns, min(l_extendedprice) cheapest FROM lineitem GROUP BY 1, 2), b AS (SELECT DISTINCT ON (l_partkey) * FROM g ORDER BY l_partkey, returns DESC, cheapest, l_suppkey) SELECT p_partkey, l_suppkey, returns, cheapest FROM part LEFT JOIN b ON p_partkey = l_partkey",
    "range_bucket_rates": f"WITH b(bucket, low, high) AS (VALUES ('tiny', 0, 20000), ('small', 20000, 80000), ('medium', 80000, 200000), ('large', 200000, 1000000)) SELECT bucket, count(*) n, {R('(count(*) FILTER (o_orderstatus = $$F$$))::DOUBLE / count(*)')} win_rate FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high GROUP BY 1",
    "hyphen_range_join": "WITH s(span, sector) AS (VALUES ('1-10', 'small'), ('11-25', 'middle'), ('26-40', 'large'), ('41-50', 'huge')) SELECT sector, count(*) n, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS value FROM part JOIN s ON p_size BETWEEN split_part(span, '-', 1)::INT AND split_part(span, '-', 2)::INT GROUP BY 1",
    "semi_anti_pack": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "state_industry_grid": f"WITH h AS (SELECT n_regionkey k, c_mktsegment s, count(*) n, avg(c_acctbal::DECIMAL(18,2)) a FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT r_name, g.c_mktsegment, coalesce(n, 0) n, {R('a', 2)} average FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) g LEFT JOIN h ON k = r_regionkey AND s = g.c_mktsegment",
    "latest_per_key": LATEST,
    "density_cube": DENSITY,
    "argmax_stringagg_percentile": ARGMAX,
    "yoy_jump": YOY,
    "minmax_features": f"WITH f AS (SELECT c_custkey, ln(1 + abs(c_acctbal)) a, c_nationkey::DOUBLE b FROM customer) SELECT c_custkey, {R('(a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0)')} size_scaled, {R('(b - min(b) OVER ()) / nullif(max(b) OVER () - min(b) OVER (), 0)')} place_scaled FROM f",
    "union_all_search_index": SEARCH,
    "run_diff": RUN_DIFF,
    "json_props_filter": "WITH e AS (SELECT event_type, (props->>'$.k')::BIGINT k FROM events) SELECT event_type, count(*) n, sum(k)::BIGINT total, 1::BIGINT documents FROM e WHERE k % 2 = 0 GROUP BY 1",
    "paged_list": PAGED,
    "predicates_pack": PREDICATES,
    "market_share": SHARE,
    "two_level_max_sum": "SELECT o_custkey, sum(m)::DOUBLE consolidated, count(*) kinds FROM (SELECT o_custkey, o_orderpriority, max(o_totalprice::DECIMAL(18,2)) m FROM orders GROUP BY 1, 2) GROUP BY 1",
    "mode_winner": MODE,
    "upsert_latest": UPSERT,
    "stratified_sample": "SELECT c_mktsegment, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s' || c_custkey), c_custkey) place FROM customer) WHERE place <= 10",
    "window_pack": "SELECT o_orderkey, count(*) OVER w n, min(o_totalprice) OVER w low, max(o_totalprice) OVER w high, (sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::DOUBLE running, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "set_operations": SETS,
    "freshness": "WITH f AS (SELECT 'orders' source, count(*) n, min(o_orderdate)::DATE::VARCHAR oldest, max(o_orderdate)::DATE::VARCHAR newest FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_shipdate)::DATE::VARCHAR, max(l_shipdate)::DATE::VARCHAR FROM lineitem UNION ALL SELECT 'events', count(*), min(ts)::DATE::VARCHAR, max(ts)::DATE::VARCHAR FROM events) SELECT *, newest < '2001-08-01' late FROM f",
    "trailing_windows": "SELECT o_custkey, " + ", ".join(f"coalesce({_MONEY_SUM.format(a=AS_OF, y=y)}, 0)::DOUBLE y{y}" for y in (2, 3, 5)) + " FROM orders GROUP BY 1",
    "distinct_counts": " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) n, count(DISTINCT {c}) kinds, count(*) FILTER ({c} IS NULL) nulls FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")),
}
QUERIES = {name: globals()[name] for name in SQL}
