"""Forms of grouping, framing, sampling and fitting that the other packs have no query of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import matching as m
from plinthwork.operators import relational as rel
from plinthwork.operators import statistics as st
from plinthwork.plans.scorecards import R

DIMENSIONS = ("state", "industry", "occupation", "year")
CUBES = ((), ("state",), ("industry",), ("occupation",), ("year",), ("state", "industry"), ("state", "year"), ("industry", "year"))


def density_cubes(spark, d):
    """Weighted membership share of eight groupings in one pass over the joined rows."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("state"), F.col("c_mktsegment").alias("industry"), F.col("o_orderpriority").alias("occupation"), F.year(F.to_date("o_orderdate")).cast("long").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("w"), (F.col("o_orderstatus") == "F").alias("member"))
    g = j.groupingSets([[F.col(c) for c in s] for s in CUBES], *DIMENSIONS).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("w").cast("double").alias("weight"), F.sum(F.when(F.col("member"), F.col("w"))).cast("double").alias("members"))
    return g.select(*DIMENSIONS, "level", "n", rounded(F.coalesce("members", F.lit(0.0)) / F.col("weight") * 100.0).alias("density"))


DENSITY = f"""WITH j AS (SELECT c_nationkey state, c_mktsegment industry, o_orderpriority occupation, year(o_orderdate::DATE)::BIGINT AS year, o_totalprice::DECIMAL(18,2) w, o_orderstatus = 'F' AS mem FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT state, industry, occupation, year, grouping(state, industry, occupation, year)::BIGINT AS level, count(*) n, sum(w)::DOUBLE weight, (sum(w) FILTER (mem))::DOUBLE members FROM j GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in CUBES)}))
SELECT state, industry, occupation, year, level, n, {R('coalesce(members, 0.0) / weight * 100.0::DOUBLE')} density FROM g"""

MARGINS = ("l_returnflag", "l_linestatus", "l_linenumber")
ROUNDS = 6


def rake_three_margins(spark, d):
    """Counts of lines fitted to three margins in turn: 100 shared by 1, 2, 3 ... over each margin's values in order."""
    cells = table(spark, d, "lineitem").groupBy(*MARGINS).agg(F.count(F.lit(1)).cast("double").alias("v"))
    targets = {}
    for c in MARGINS:
        t = cells.select(c).distinct().withColumn("place", F.row_number().over(Window.orderBy(c)))  # a margin's few values
        whole = t.agg(F.sum("place").alias("whole"))
        targets[c] = t.join(F.broadcast(whole)).select(c, (F.col("place") * 100.0 / F.col("whole")).alias(f"t_{c}"))
    return st.rake(cells, "v", targets, ROUNDS).select(*MARGINS, rounded("v").alias("v"))


def _rake_sql():
    place = ", ".join(f"dense_rank() OVER (ORDER BY {c}) p{i}" for i, c in enumerate(MARGINS))
    share = ", ".join(f"p{i} * 100.0::DOUBLE / (SELECT sum(p) FROM (SELECT DISTINCT p{i} p FROM a)) t{i}" for i in range(3))
    steps = [f"c0 AS (SELECT {', '.join(MARGINS)}, v, {share} FROM a)"]
    for k in range(3 * ROUNDS):
        c, i = MARGINS[k % 3], k % 3
        steps.append(f"c{k + 1} AS (SELECT {', '.join(MARGINS)}, t0, t1, t2, v * t{i} / sum(v) OVER (PARTITION BY {c}) v FROM c{k})")
    return f"WITH a AS (SELECT *, {place} FROM (SELECT {', '.join(MARGINS)}, count(*)::DOUBLE v FROM lineitem GROUP BY ALL)), {', '.join(steps)} SELECT {', '.join(MARGINS)}, {R('v')} v FROM c{3 * ROUNDS}"


def window_frames(spark, d):
    """Value-range frames, the last known value, the second value, and cumulative distribution over a customer's orders."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1992-01-01"))).alias("day"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("seen"))
    w = Window.partitionBy("o_custkey").orderBy("day")
    rows = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    return o.select("o_orderkey", F.count(F.lit(1)).over(w.rangeBetween(-90, 0)).alias("recent"), F.last("seen", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("last_seen"), F.nth_value("o_orderkey", 2).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"), rounded(F.cume_dist().over(w), 6).alias("share"))


FRAMES = f"""WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END seen FROM orders)
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) recent, last_value(seen IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) last_seen, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, {R('cume_dist() OVER (PARTITION BY o_custkey ORDER BY day)', 6)} AS share FROM o"""

QUOTA = 100


def quota_sample(spark, d):
    """A hundred customers shared over segments by size: whole parts first, then the largest remainders."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    per = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.sum("n").alias("whole"))
    per = per.join(F.broadcast(whole)).withColumn("base", F.floor(F.col("n") * QUOTA / F.col("whole"))).withColumn("rest", F.pmod(F.col("n") * QUOTA, F.col("whole")))
    every = Window.partitionBy(F.lit(0))  # one row a segment
    per = per.withColumn("left", QUOTA - F.sum("base").over(every)).withColumn("place", F.row_number().over(every.orderBy(F.desc("rest"), "c_mktsegment")))
    per = per.select("c_mktsegment", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))
    drawn = c.withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_custkey") % 97, "c_custkey"))).where(F.col("place") <= QUOTA)  # no quota is larger
    return drawn.join(F.broadcast(per), "c_mktsegment").where(F.col("place") <= F.col("quota")).select("c_custkey", "c_mktsegment", "quota")


SAMPLE = f"WITH p AS (SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1), q AS (SELECT c_mktsegment, (n * {QUOTA}) // sum(n) OVER () base, (n * {QUOTA}) % sum(n) OVER () rest FROM p), r AS (SELECT c_mktsegment, base, {QUOTA} - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rest DESC, c_mktsegment) pl FROM q), k AS (SELECT c_mktsegment, (base + (pl <= lft)::INT)::BIGINT quota FROM r), d AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 97, c_custkey) pl FROM customer) SELECT c_custkey, c_mktsegment, quota FROM d JOIN k USING (c_mktsegment) WHERE pl <= quota"

#: Pairs of names, and the parent that a series has, written out.
SERIES = (("Acme Trust 1", "Acme Trust 2", "acme"), ("Fund Series A", "Fund Series B", "fund"), ("Delta Local 12", "Delta Local 7", "delta"), ("Delta Foods", "Delta Steel", None), ("Blue River II", "Blue River IV", "blue river"))


def hierarchy_edges(spark, d):
    """Parents of pairs of names that differ by a trailing number, numeral or series only; pairs as customers have them."""
    one, two = (F.array(*[F.lit(s[i]) for s in SERIES]) for i in (0, 1))
    at = (F.col("c_custkey") % len(SERIES) + 1).cast("int")
    c = table(spark, d, "customer").select("c_custkey", F.element_at(one, at).alias("a"), F.element_at(two, at).alias("b"))
    return c.select("c_custkey", m.series_parent("a", "b").alias("parent"))


EDGES = f"WITH s(i, parent) AS (VALUES {', '.join('(' + str(i) + ', ' + ('NULL' if s[2] is None else repr(s[2])) + ')' for i, s in enumerate(SERIES))}) SELECT c_custkey, parent FROM customer JOIN s ON c_custkey % {len(SERIES)} = i"


def json_arrays(spark, d):
    """Each order's lines as one ordered JSON array, and what is read back from its elements."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("mode")).alias("e"))
    g = l.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("lines"))
    e = F.from_json("lines", "array<struct<line:bigint,mode:string>>")
    return g.select("l_orderkey", F.size(e).cast("long").alias("n"), F.get_json_object("lines", "$[0].mode").alias("first_mode"), F.array_join(F.array_sort(F.array_distinct(F.transform(e, lambda x: x["mode"]))), ",").alias("modes"))


ARRAYS = "SELECT l_orderkey, count(*) n, arg_min(l_returnflag, (l_linenumber, l_returnflag)) first_mode, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') modes FROM lineitem GROUP BY 1"

PATTERNS = ("%RED%", "%small%", "_ot %")
SORTS = {"name": "p_name", "size": "p_size", "key": "p_partkey"}


def ilike_any_sorted(spark, d):
    """Parts whose name is like any of several patterns whatever the case, by a sort name from a fixed list."""
    asked = "size"
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    like = reduce(lambda a, b: a | b, [F.ilike("p_name", F.lit(x)) for x in PATTERNS])
    return rel.first_by(p.where(like), ["p_name"], [F.desc(SORTS[asked]), F.asc("p_partkey")]).select("p_partkey", "p_name", "p_size")


ILIKE = f"SELECT DISTINCT ON (p_name) p_partkey, p_name, p_size FROM part WHERE {' OR '.join(f'p_name ILIKE {x!r}' for x in PATTERNS)} ORDER BY p_name, p_size DESC, p_partkey"

SQL = {"density_cubes": DENSITY, "rake_three_margins": _rake_sql(), "window_frames": FRAMES, "quota_sample": SAMPLE, "hierarchy_edges": EDGES, "json_arrays": ARRAYS, "ilike_any_sorted": ILIKE}
QUERIES = {name: globals()[name] for name in SQL}
