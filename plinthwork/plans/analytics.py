"""Similarity, survey statistics and network queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import cut, table
from plinthwork.operators import relational as rel
from plinthwork.operators import statistics as st
from plinthwork.plans.scorecards import R

MONEY = "decimal(18,2)"


def gower_topk(spark, d):
    """Five nearest parts within a brand by weighted Gower distance over size, price, type and name."""
    p = table(spark, d, "part")
    f = rel.min_max(p.select("p_partkey", "p_brand", "p_type", F.log1p("p_retailprice").alias("price"), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size").cast("double")).alias("size")), ["price", "size"])
    f = f.select("p_partkey", "p_brand", "p_type", "price_scaled", "size_scaled")
    features = [("price_scaled", "numeric", 2.0), ("size_scaled", "numeric", 1.5), ("p_type", "code", 1.0)]
    return st.gower_nearest(f, "p_partkey", "p_brand", features, 5).withColumn("place", F.col("place").cast("long"))


GOWER = f"""WITH b AS (SELECT p_partkey, p_brand, p_type, ln(1 + p_retailprice) price, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size::DOUBLE END AS size FROM part), f AS (SELECT p_partkey, p_brand, p_type, (price - min(price) OVER ()) / nullif(max(price) OVER () - min(price) OVER (), 0) p, (size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0) s FROM b),
n AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 3), d AS (SELECT x.p_partkey a, y.p_partkey other, {R("(abs(x.p - y.p) * 2.0::DOUBLE + CASE WHEN x.s IS NOT NULL AND y.s IS NOT NULL THEN abs(x.s - y.s) * 1.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN length(x.p_type) >= 6 AND left(x.p_type, 6) = left(y.p_type, 6) THEN 0.0::DOUBLE WHEN left(x.p_type, 4) = left(y.p_type, 4) THEN 0.2::DOUBLE WHEN left(x.p_type, 2) = left(y.p_type, 2) THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END * 1.0::DOUBLE) / (2.0::DOUBLE + CASE WHEN x.s IS NOT NULL AND y.s IS NOT NULL THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + 1.0::DOUBLE)", 6)} distance FROM f x JOIN f y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey SEMI JOIN n ON x.p_brand = n.p_brand)
SELECT a p_partkey, other, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, other) place FROM d) WHERE place <= 5"""


def _brand_mix(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy("l_suppkey", F.concat("p_brand", F.lit("|"), (F.col("p_size") % 5).cast("string")).alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))


MIX = "v AS (SELECT l_suppkey, p_brand || '|' || (p_size % 5) k, sum(l_quantity::BIGINT)::BIGINT q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def sparse_cosine(spark, d):
    return st.sparse_cosine(_brand_mix(spark, d), "l_suppkey", "k", "q", 0.3).select("a", "b", "shared", rounded("cosine").alias("cosine"))


def weighted_jaccard(spark, d):
    return st.weighted_jaccard(_brand_mix(spark, d), "l_suppkey", "k", "q").select("a", "b", rounded("jaccard").alias("jaccard"))


COSINE = f"""WITH {MIX}, u AS (SELECT * FROM v), n AS (SELECT l_suppkey s, sqrt(sum(q * q)::DOUBLE) n FROM u GROUP BY 1), p AS (SELECT x.l_suppkey a, y.l_suppkey b, sum(x.q * y.q)::DOUBLE s, count(*) shared FROM u x JOIN u y ON x.k = y.k AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2), c AS (SELECT a, b, shared, p.s / (i.n * j.n) c FROM p JOIN n i ON a = i.s JOIN n j ON b = j.s)
SELECT a, b, shared, {R("c")} AS cosine FROM c WHERE c >= 0.3"""
JACCARD = f"""WITH {MIX}, t AS (SELECT l_suppkey s, sum(q) t FROM v GROUP BY 1), p AS (SELECT x.l_suppkey a, y.l_suppkey b, sum(least(x.q, y.q)) s FROM v x JOIN v y ON x.k = y.k AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2)
SELECT a, b, {R("p.s::DOUBLE / (i.t + j.t - p.s)::DOUBLE")} jaccard FROM p JOIN t i ON a = i.s JOIN t j ON b = j.s"""


def _nearest(spark, d, k):
    """A stated query set, every twentieth vector, against all."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("truth"), F.col("embedding").alias("q"))
    return st.nearest_vectors(q, e.select("vec_id", "label", "embedding"), k)


def embed_topk(spark, d):
    """Ten nearest vectors of each query vector by exact cosine."""
    return _nearest(spark, d, 10).select("query", "vec_id", "cosine", F.col("place").cast("long").alias("place"))


def embed_knn_vote(spark, d):
    """Label by the summed similarity of seven neighbours, with its share as confidence."""
    k = _nearest(spark, d, 7)
    v = k.groupBy("query", "truth", "label").agg(F.sum(F.col("cosine").cast("decimal(18,6)")).alias("s"))
    v = v.withColumn("share", F.col("s").cast("double") / F.sum("s").over(Window.partitionBy("query")).cast("double"))
    best = rel.first_by(v, ["query"], [F.desc("s"), F.asc("label")])
    share = rounded("share")
    return best.select("query", F.col("truth").cast("long").alias("truth"), F.col("label").cast("long").alias("label"), share.alias("confidence"), F.when(share >= 0.85, "high").when(share >= 0.60, "medium").otherwise("low").alias("band"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE))"
NEAR = f"q AS (SELECT vec_id AS query, label truth, embedding q FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query, truth, vec_id, label, {R('(' + DOT.format(x='embedding', y='q') + ') / sqrt((' + DOT.format(x='embedding', y='embedding') + ') * (' + DOT.format(x='q', y='q') + '))', 6)} AS cosine FROM embeddings JOIN q ON vec_id <> query)"
TOPK = f"WITH {NEAR} SELECT query, vec_id, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) place FROM c) WHERE place <= 10"
KNN = f"""WITH {NEAR}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) place FROM c) WHERE place <= 7), v AS (SELECT query, truth, label, sum(cosine::DECIMAL(18,6)) s FROM k GROUP BY 1, 2, 3), w AS (SELECT *, s::DOUBLE / (sum(s) OVER (PARTITION BY query))::DOUBLE share FROM v), b AS (SELECT DISTINCT ON (query) *, {R("share")} cf FROM w ORDER BY query, s DESC, label)
SELECT query, truth::BIGINT truth, label::BIGINT AS label, cf confidence, CASE WHEN cf >= 0.85 THEN 'high' WHEN cf >= 0.60 THEN 'medium' ELSE 'low' END band FROM b"""


def _shares(spark, d):
    """Shares of priorities among a segment's orders by number and by value, in percent."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    g = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("v"))
    w = Window.partitionBy("c_mktsegment")
    return g.select("c_mktsegment", "o_orderpriority", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("acs"), F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("v").cast("double") * 100.0 / F.sum("v").over(w).cast("double")).alias("lodes"))


SHARES = "g AS (SELECT c_mktsegment, o_orderpriority, count(*) n, sum(o_totalprice::DECIMAL(18,2)) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), s AS (SELECT c_mktsegment, o_orderpriority, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY c_mktsegment) acs, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN v::DOUBLE * 100.0::DOUBLE / (sum(v) OVER (PARTITION BY c_mktsegment))::DOUBLE END lodes FROM g)"


def ipf_blend(spark, d):
    """Blend of two signals by weight over what is present, and their proportional fit, both to 100."""
    s = _shares(spark, d)
    b = st.blend(s, ["c_mktsegment"], [("acs", 0.6), ("lodes", 0.4)])
    f = st.fit_margins(s.where("lodes is not null"), ["c_mktsegment"], "acs", "lodes").select("c_mktsegment", "o_orderpriority", F.col("value").alias("fit"))
    return b.join(f, ["c_mktsegment", "o_orderpriority"], "left").select("c_mktsegment", "o_orderpriority", rounded("value").alias("blend"), rounded("fit").alias("fit"))


def damped_ipf(spark, d):
    """The fit on square roots, with a floor."""
    return st.fit_margins(_shares(spark, d).where("lodes is not null"), ["c_mktsegment"], "acs", "lodes", 0.5, 0.1).select("c_mktsegment", "o_orderpriority", rounded("value").alias("value"))


IPF = f"""WITH {SHARES}, m AS (SELECT *, (acs * 0.6::DOUBLE + coalesce(lodes, 0) * 0.4::DOUBLE) / (CASE WHEN lodes IS NULL THEN 0.6::DOUBLE + 0.0::DOUBLE ELSE 0.6::DOUBLE + 0.4::DOUBLE END) b, acs * lodes f FROM s)
SELECT c_mktsegment, o_orderpriority, {R("b * 100.0::DOUBLE / sum(b) OVER (PARTITION BY c_mktsegment)")} blend, {R("f * 100.0::DOUBLE / sum(f) OVER (PARTITION BY c_mktsegment)")} fit FROM m"""
DAMPED = f"""WITH {SHARES}, m AS (SELECT *, pow(greatest(acs, 0.1::DOUBLE), 0.5::DOUBLE) * pow(greatest(lodes, 0.1::DOUBLE), 0.5::DOUBLE) f FROM s WHERE lodes IS NOT NULL)
SELECT c_mktsegment, o_orderpriority, {R("f * 100.0::DOUBLE / sum(f) OVER (PARTITION BY c_mktsegment)")} AS value FROM m"""


def raked_table(spark, d):
    """Two-way table of statuses by priorities, raked to equal margins in four rounds."""
    o = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rows = o.select("o_orderstatus").distinct().withColumn("target", F.lit(100.0))
    cols = o.select("o_orderpriority").distinct().withColumn("target", F.lit(60.0))
    return st.raking(o, "n", "o_orderstatus", "o_orderpriority", rows, cols, 4).select("o_orderstatus", "o_orderpriority", rounded("value").alias("value"))


def _rake_sql():
    out, last = ["r0 AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"], "r0"
    for i in range(1, 9):
        key, target = (("o_orderstatus", 100.0) if i % 2 else ("o_orderpriority", 60.0))
        out.append(f"r{i} AS (SELECT o_orderstatus, o_orderpriority, v * {target}::DOUBLE / nullif(sum(v) OVER (PARTITION BY {key}), 0) AS v FROM {last})")
        last = f"r{i}"
    return f"WITH {', '.join(out)} SELECT o_orderstatus, o_orderpriority, {R('v')} AS value FROM {last}"


LEVELS = [(["c_mktsegment", "region", "status"], 40), (["c_mktsegment", "region"], 30), (["region", "status"], 20), (["status"], 20), ([], 20)]


def _errors(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.select("o_orderkey", "c_mktsegment", F.col("n_regionkey").cast("long").alias("region"), F.col("o_orderstatus").alias("status"), ((F.col("o_totalprice") / 10000 - 20).cast("decimal(18,6)")).alias("error"))


ERRORS = "e AS (SELECT o_orderkey, c_mktsegment, n_regionkey::BIGINT region, o_orderstatus status, (o_totalprice / 10000 - 20)::DECIMAL(18,6) error FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def calibration_cascade(spark, d):
    """Offset of the most specific bucket with enough training rows, damped by 0.85."""
    e = _errors(spark, d)
    t = st.bucket_offsets(e.where("o_orderkey % 4 <> 0"), LEVELS, "error")
    out = st.calibrate(e.where("o_orderkey % 4 = 0"), LEVELS, t, 0.85)
    return out.select("o_orderkey", rounded("offset").alias("offset"), F.col("level").cast("long").alias("level"))


def _calibration_sql():
    ctes, joins, offs = [], [], []
    for i, (keys, n) in enumerate(LEVELS):
        k = ", ".join(keys)
        ctes.append(f"b{i} AS (SELECT {k + ', ' if k else ''}least(greatest(avg(error)::DOUBLE, -15.0::DOUBLE), 15.0::DOUBLE) o FROM e WHERE o_orderkey % 4 <> 0 {'GROUP BY ' + k if k else ''} HAVING count(*) >= {n})")
        joins.append(f"LEFT JOIN b{i} ON " + (" AND ".join(f"b{i}.{x} = e.{x}" for x in keys) or "true"))
        offs.append(f"b{i}.o")
    level = " ".join(f"WHEN {o} IS NOT NULL THEN {i}" for i, o in enumerate(offs))
    return f"WITH {ERRORS}, {', '.join(ctes)} SELECT o_orderkey, {R('coalesce(' + ', '.join(offs) + ', 0.0::DOUBLE) * 0.85::DOUBLE')} AS \"offset\", (CASE {level} ELSE -1 END)::BIGINT AS level FROM e {' '.join(joins)} WHERE o_orderkey % 4 = 0"


def james_stein(spark, d):
    """Bucket means drawn to the parent level's by their size."""
    e = _errors(spark, d)
    top = e.agg(F.avg("error").cast("double").alias("m0"))
    mid = e.groupBy("region").agg(F.avg("error").cast("double").alias("m1"), F.count(F.lit(1)).alias("n1"))
    low = e.groupBy("region", "c_mktsegment").agg(F.avg("error").cast("double").alias("m2"), F.count(F.lit(1)).alias("n2"))
    mid = mid.join(F.broadcast(top)).withColumn("s1", st.shrunk("m1", "n1", "m0", 50.0))
    return low.join(mid, "region").select("region", "c_mktsegment", rounded(st.shrunk("m2", "n2", "s1", 50.0)).alias("shrunk"))


JS = f"""WITH {ERRORS}, t AS (SELECT avg(error)::DOUBLE m0 FROM e), m AS (SELECT region, avg(error)::DOUBLE m1, count(*) n1 FROM e GROUP BY 1), l AS (SELECT region, c_mktsegment, avg(error)::DOUBLE m2, count(*) n2 FROM e GROUP BY 1, 2), s AS (SELECT region, m1 * (n1 / (n1 + 50.0::DOUBLE)) + m0 * (1.0::DOUBLE - n1 / (n1 + 50.0::DOUBLE)) s1 FROM m CROSS JOIN t)
SELECT region, c_mktsegment, {R("m2 * (n2 / (n2 + 50.0::DOUBLE)) + s1 * (1.0::DOUBLE - n2 / (n2 + 50.0::DOUBLE))")} shrunk FROM l JOIN s USING (region)"""


def metrics_pack(spark, d):
    e = _errors(spark, d).withColumn("error", F.col("error").cast("double"))
    m = st.error_metrics(e, ["c_mktsegment"], "error")
    return m.select("c_mktsegment", *[rounded(c).alias(c) for c in m.columns[1:]])


METRICS = f"""WITH {ERRORS}, x AS (SELECT c_mktsegment, error::DOUBLE e FROM e), m AS (SELECT c_mktsegment, avg(abs(e)) mae, sqrt(avg(e * e)) rmse, max(abs(e)) largest, avg(e) signed, avg((abs(e) > 20)::INT) o20, avg((abs(e) > 30)::INT) o30 FROM x GROUP BY 1)
SELECT c_mktsegment, {R("mae")} mae, {R("rmse")} rmse, {R("largest")} largest, {R("signed")} signed, {R("o20")} over20, {R("o30")} over30, {R("mae + o20 * 20.0::DOUBLE + o30 * 35.0::DOUBLE + abs(signed) * 0.15::DOUBLE")} composite FROM m"""


def interlock_pairs(spark, d):
    """Suppliers that share parts (as boards share directors), by how many, at five or more."""
    return st.interlocks(table(spark, d, "lineitem"), "l_suppkey", "l_partkey").where("shared >= 5")


def two_hop(spark, d):
    """Suppliers linked only through a third, over pairs that share a fifth more parts than pairs do on average."""
    pairs = cut(st.interlocks(table(spark, d, "lineitem"), "l_suppkey", "l_partkey"), "interlocks")  # read several times
    usual = pairs.agg((F.sum("shared") / F.count(F.lit(1))).alias("usual"))
    near = pairs.join(F.broadcast(usual)).where(F.col("shared") > F.col("usual") * 1.2).select("a", "b")
    return st.two_hops(cut(near, "near"))


PAIRS = "e AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), i AS (SELECT x.s a, y.s b, count(*) shared FROM e x JOIN e y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2)"
HOPS = f"WITH {PAIRS}, t AS (SELECT sum(shared)::DOUBLE / count(*) m FROM i), j AS (SELECT a, b FROM i, t WHERE shared > m * 1.2::DOUBLE), u AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j) SELECT x.a, y.b c, count(DISTINCT x.b) via FROM u x JOIN u y ON x.b = y.a AND x.a <> y.b WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.a = x.a AND z.b = y.b) GROUP BY 1, 2"


def _ownership(spark, d):
    """Edges child to parent: halves of keys, with a cycle of three and a loop among them."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("child"), F.when(k == 1, 1).when(k.isin(2, 3), k + 1).when(k == 4, 2).otherwise(F.floor(k / 2)).cast("long").alias("parent"))


def recursive_parents(spark, d):
    return st.ultimate_parents(_ownership(spark, d)).withColumn("steps", F.col("steps").cast("long"))


PARENTS = """WITH RECURSIVE e AS (SELECT c_custkey child, CASE WHEN c_custkey = 1 THEN 1 WHEN c_custkey IN (2, 3) THEN c_custkey + 1 WHEN c_custkey = 4 THEN 2 ELSE c_custkey // 2 END::BIGINT parent FROM customer), p AS (SELECT child, parent ancestor, 1 steps, [child, parent] path FROM e WHERE child <> parent UNION ALL SELECT p.child, e.parent, steps + 1, list_append(path, e.parent) FROM p JOIN e ON p.ancestor = e.child WHERE steps < 10 AND NOT list_contains(path, e.parent))
SELECT DISTINCT ON (child) child, ancestor, steps::BIGINT steps FROM p ORDER BY child, steps DESC, ancestor"""


def location_quotient(spark, d):
    """Share of a segment in a nation over its share in all, capped at five, with a log density score."""
    c = table(spark, d, "customer")
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    here, there, all_ = (F.sum("n").over(Window.partitionBy(*k)) for k in (["c_nationkey"], ["c_mktsegment"], []))
    q = F.least((F.col("n") / here) / (there / all_), F.lit(5.0))
    return g.select(F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment", rounded(q).alias("quotient"), rounded(F.log1p("n")).alias("density"))


LQ = f"""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) n FROM customer GROUP BY 1, 2) SELECT c_nationkey::BIGINT nation, c_mktsegment, {R("least((n / (sum(n) OVER (PARTITION BY c_nationkey))::DOUBLE) / ((sum(n) OVER (PARTITION BY c_mktsegment))::DOUBLE / (sum(n) OVER ())::DOUBLE), 5.0::DOUBLE)")} quotient, {R("ln(1 + n)")} density FROM g"""


def state_estimates(spark, d):
    """National rate of a segment times a nation's multiplier, held within 0 and 100."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn("won", (F.col("o_orderstatus") == "F").cast("int"))
    overall = j.agg((F.sum("won") / F.count(F.lit(1))).alias("r0"))
    seg = j.groupBy("c_mktsegment").agg((F.sum("won") / F.count(F.lit(1))).alias("r1"))
    nat = j.groupBy("c_nationkey").agg((F.sum("won") / F.count(F.lit(1))).alias("r2"))
    grid = nat.crossJoin(F.broadcast(seg)).join(F.broadcast(overall))  # nations by segments: two reference lists
    return grid.select(F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment", rounded(F.least(F.greatest(F.col("r1") * (F.col("r2") / F.nullif("r0", F.lit(0.0))) * 100, F.lit(0.0)), F.lit(100.0))).alias("estimate"))


ESTIMATES = f"""WITH j AS (SELECT c_nationkey, c_mktsegment, (o_orderstatus = 'F')::INT won FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT sum(won)::DOUBLE / count(*) r0 FROM j), s AS (SELECT c_mktsegment, sum(won)::DOUBLE / count(*) r1 FROM j GROUP BY 1), n AS (SELECT c_nationkey, sum(won)::DOUBLE / count(*) r2 FROM j GROUP BY 1)
SELECT c_nationkey::BIGINT nation, c_mktsegment, {R("least(greatest(r1 * (r2 / nullif(r0, 0)) * 100, 0.0::DOUBLE), 100.0::DOUBLE)")} estimate FROM n CROSS JOIN s CROSS JOIN t"""

SQL = {
    "gower_topk": GOWER, "sparse_cosine": COSINE, "weighted_jaccard": JACCARD, "embed_topk": TOPK, "embed_knn_vote": KNN, "ipf_blend": IPF, "damped_ipf": DAMPED, "raked_table": _rake_sql(),
    "calibration_cascade": _calibration_sql(), "james_stein": JS, "metrics_pack": METRICS, "interlock_pairs": f"WITH {PAIRS} SELECT * FROM i WHERE shared >= 5", "two_hop": HOPS, "recursive_parents": PARENTS, "location_quotient": LQ, "state_estimates": ESTIMATES,
}
QUERIES = {name: globals()[name] for name in SQL}
