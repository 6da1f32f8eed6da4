"""Deduplication of master records in phases, and the identity graph, over records derived from customers.

Three customers in a row are records of one organisation in different registers, with names cut, reordered or
extended, gaps in every field, shared and conflicting numbers, and every ninth record protected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import masters as ms
from plinthwork.plans import matching as pm
from plinthwork.plans.linkage import lcs_sql, sorted_sql
from plinthwork.plans.scorecards import R

ORIGINS = ["f7", "sam", "mergent", "bmf", "sec", "990", "gleif", "osha"]


def _records(spark, d):
    k = F.col("c_custkey")
    e = F.floor(k / 3)
    one, two, three = (pm._pick(w, e) for w in (pm.FIRST, pm.SECOND, pm.THIRD))
    name = F.when(k % 6 == 1, F.concat_ws(" ", one, two, three, F.lit("co"))).when(k % 3 == 2, F.concat_ws(" ", three, one, two)).when(k % 15 == 0, F.concat_ws(" ", one, two)).otherwise(F.concat_ws(" ", one, two, three))
    origin = pm._pick(ORIGINS, k)
    return table(spark, d, "customer").select(
        k.alias("id"), name.alias("name"), F.when(e % 4 < 2, F.concat(F.lit("city"), (e % 300).cast("string"))).when(e % 4 == 2, "").alias("city"), F.concat(F.lit("S"), (e % 50).cast("string")).alias("state"),
        F.when(e % 4 != 3, F.concat(F.lpad((e % 4000).cast("string"), 5, "1"), F.when(k % 2 == 0, "-0001").otherwise(""))).alias("zip"), F.when(k % 5 != 1, (e % 7 + 30).cast("string")).alias("naics"),
        F.when(k % 50 == 7, F.concat(F.lit("E"), (e + 1).cast("string"))).when((k % 6).isin(0, 2), F.concat(F.lit("E"), e.cast("string"))).alias("ein"),
        F.when(k % 3 != 2, k % 500).alias("employees"), F.when(k % 2 == 0, origin).alias("employees_source"), origin.alias("origin"), (k % 9 == 0).alias("protected"),
        F.array_distinct(F.array(origin, F.when(k % 9 == 0, "f7").otherwise(origin), F.when(k % 7 == 0, "extra").otherwise(origin))).alias("sources"),
        *[(k % n == 0).alias(c) for n, c in zip((4, 10, 6, 11), ms.FLAGS)],
    )


def master_dedup(spark, d):
    """The surviving masters after all phases, with what they absorbed and a quality score."""
    masters = ms.dedup_masters(_records(spark, d))[0]
    return masters.select("id", *ms.TEXTS, "employees", "employees_source", *ms.FLAGS, F.size("sources").cast("long").alias("n_sources"), F.col("quality").cast("long").alias("quality"))


def master_merges(spark, d):
    """The log of merges with the master that finally holds each absorbed record."""
    _, log, members = ms.dedup_masters(_records(spark, d))
    return log.join(members, log["loser"] == members["id"]).select("loser", "winner", "phase", rounded("similarity").alias("similarity"), rounded("confidence").alias("confidence"), "master")


_E, _K = "(c_custkey // 3)", "c_custkey"
_W = [pm._pick_sql(w, _E) for w in (pm.FIRST, pm.SECOND, pm.THIRD)]
_ORIGIN = pm._pick_sql(ORIGINS, _K)
RECORDS = f"""p0 AS (SELECT {_K} id, CASE WHEN {_K} % 6 = 1 THEN {_W[0]} || ' ' || {_W[1]} || ' ' || {_W[2]} || ' co' WHEN {_K} % 3 = 2 THEN {_W[2]} || ' ' || {_W[0]} || ' ' || {_W[1]} WHEN {_K} % 15 = 0 THEN {_W[0]} || ' ' || {_W[1]} ELSE {_W[0]} || ' ' || {_W[1]} || ' ' || {_W[2]} END AS name,
CASE WHEN {_E} % 4 < 2 THEN 'city' || ({_E} % 300) END city, 'S' || ({_E} % 50) state, CASE WHEN {_E} % 4 <> 3 THEN lpad(({_E} % 4000)::VARCHAR, 5, '1') || CASE WHEN {_K} % 2 = 0 THEN '-0001' ELSE '' END END zip, CASE WHEN {_K} % 5 <> 1 THEN ({_E} % 7 + 30)::VARCHAR END naics,
CASE WHEN {_K} % 50 = 7 THEN 'E' || ({_E} + 1) WHEN {_K} % 6 IN (0, 2) THEN 'E' || {_E} END ein, CASE WHEN {_K} % 3 <> 2 THEN {_K} % 500 END employees, CASE WHEN {_K} % 2 = 0 THEN {_ORIGIN} END employees_source, {_ORIGIN} origin, {_K} % 9 = 0 protected,
list_distinct([{_ORIGIN}, CASE WHEN {_K} % 9 = 0 THEN 'f7' END, CASE WHEN {_K} % 7 = 0 THEN 'extra' END]) sources, {", ".join(f"{_K} % {n} = 0 {c}" for n, c in zip((4, 10, 6, 11), ms.FLAGS))} FROM customer)"""
_RANK = "CASE {x} WHEN 'f7' THEN 0 WHEN 'sam' THEN 1 WHEN 'mergent' THEN 2 WHEN 'bmf' THEN 3 WHEN 'sec' THEN 4 WHEN '990' THEN 5 WHEN 'gleif' THEN 6 ELSE 99 END"
_COUNTED = "CASE coalesce({x}employees_source, {x}origin) WHEN 'f7' THEN 0 WHEN 'mergent' THEN 1 WHEN 'sam' THEN 2 WHEN 'bmf' THEN 3 WHEN '990' THEN 4 ELSE 99 END"
# name, key, who takes part, acceptance, largest block; written out apart from the operator's table
_STEPS = (
    ("ein", "ein", "ein IS NOT NULL", "sim >= 0.70 OR s1 = s2", 1 << 40), ("name_state_exact", "name || '|' || state", "true", "true", 1 << 40), ("name_geo_3a", "substr(zip, 1, 5)", "zip IS NOT NULL", "sim >= 0.82", 500),
    ("name_geo_3b", "city || '|' || state", "city IS NOT NULL", "sim >= 0.85", 500), ("name_geo_3c", "state || '|' || substr(name, 1, 8)", "city IS NULL AND zip IS NULL", "sim >= 0.85", 200),
)


def _phase_sql(i, name, key, who, accept, largest):
    longest = lambda c: f"arg_max(l.{c}, {{'n': length(l.{c}), 'i': -l.id}}) FILTER (l.{c} IS NOT NULL) g_{c}"
    text = lambda c: f"CASE WHEN p.{c} IS NULL OR length(g_{c}) > length(p.{c}) THEN coalesce(g_{c}, p.{c}) ELSE p.{c} END {c}"
    take = f"(g_n.employees IS NOT NULL AND (p.employees IS NULL OR g_n.r < {_COUNTED.format(x='p.')}))"
    return f"""b{i} AS (SELECT *, {key} bk, first_value(id) OVER g w, count(*) OVER (PARTITION BY {key}) n FROM p{i} WHERE {who} WINDOW g AS (PARTITION BY {key} ORDER BY NOT protected, {_RANK.format(x='origin')}, id)),
c{i} AS (SELECT l.id loser, x.id winner, l.state s1, x.state s2, {sorted_sql('l.name')} t1, {sorted_sql('x.name')} t2 FROM b{i} l JOIN p{i} x ON x.id = l.w WHERE l.n BETWEEN 2 AND {largest} AND l.id <> x.id AND NOT (l.protected AND x.protected)),
m{i} AS (SELECT loser, winner, '{name}' AS phase, sim FROM (SELECT *, 2.0::DOUBLE * {lcs_sql('t1', 't2')} / (length(t1) + length(t2)) sim FROM c{i}) WHERE {accept}),
g{i} AS (SELECT winner, {", ".join(longest(c) for c in ms.TEXTS)}, arg_min({{'employees': l.employees, 'source': coalesce(l.employees_source, l.origin), 'r': {_COUNTED.format(x='l.')}}}, {{'r': {_COUNTED.format(x='l.')}, 'i': l.id}}) FILTER (l.employees IS NOT NULL) g_n, {", ".join(f"bool_or(l.{c}) g_{c}" for c in ms.FLAGS)}, flatten(list(l.sources)) g_sources FROM m{i} JOIN p{i} l ON l.id = loser GROUP BY 1),
p{i + 1} AS (SELECT p.id, {", ".join(text(c) for c in ms.TEXTS)}, CASE WHEN {take} THEN g_n.employees ELSE p.employees END employees, CASE WHEN {take} THEN g_n.source ELSE p.employees_source END employees_source, origin, protected, list_distinct(list_concat(p.sources, coalesce(g_sources, []))) sources, {", ".join(f"{c} OR coalesce(g_{c}, false) {c}" for c in ms.FLAGS)} FROM p{i} p ANTI JOIN m{i} ON loser = p.id LEFT JOIN g{i} ON winner = p.id)"""


_PHASES = ", ".join(_phase_sql(i, *s) for i, s in enumerate(_STEPS))
_FULL, _PLACED = "employees IS NOT NULL AND naics IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL", "city IS NOT NULL AND state IS NOT NULL AND (employees IS NOT NULL OR naics IS NOT NULL)"
DEDUPED = f"""WITH {RECORDS}, {_PHASES}
SELECT id, {", ".join(ms.TEXTS)}, employees, employees_source, {", ".join(ms.FLAGS)}, len(sources) n_sources,
CASE WHEN len(sources) >= 5 OR (len(sources) >= 4 AND {_FULL}) THEN 100 WHEN len(sources) >= 4 OR (len(sources) >= 3 AND {_FULL}) THEN 80 WHEN len(sources) >= 3 OR (len(sources) >= 2 AND {_PLACED}) THEN 60 WHEN {_PLACED} THEN 40 ELSE 20 END::BIGINT AS quality FROM p{len(_STEPS)}"""
MERGES = f"""WITH RECURSIVE {RECORDS}, {_PHASES}, lg AS ({" UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(_STEPS)))}),
ch AS (SELECT loser, winner AS spot FROM lg UNION ALL SELECT ch.loser, lg.winner FROM ch JOIN lg ON lg.loser = ch.spot)
SELECT loser, winner, phase, {R('sim')} similarity, {R('least(0.99::DOUBLE, greatest(0.60::DOUBLE, sim))')} confidence, spot AS master FROM lg JOIN (SELECT * FROM ch ANTI JOIN lg ON lg.loser = ch.spot) USING (loser)"""


def _identities(spark, d):
    """Registers of suppliers and customers: nodes with some known numbers, and edges of three tiers."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", F.col("c_acctbal").alias("v"))
    k = F.col("k")
    group = F.floor(k / 4)
    nodes = c.select(k.alias("node"), F.when(k % 4 == 1, F.concat(F.lit("E"), F.floor(k / 8).cast("string"))).when(k % 12 == 2, F.concat(F.lit("X"), k.cast("string"))).alias("identifier"))
    star = lambda tier, head, where: c.where(where).select(head.alias("a"), k.alias("b"), F.lit(tier).alias("tier"))
    edges = star("EIN_EXACT", group * 4 + 1, (k % 4 == 2) & (k % 3 != 0)).unionByName(star("LEI_EXACT", group * 4, k % 4 == 1)).unionByName(star("NAME_STATE", F.greatest(k - 3, F.lit(1)), (k % 5 == 0) | (k % 7 == 3)))
    inside = c.select(F.col("k").alias("a"))
    return nodes, edges.join(inside, "a")


TIERS = {"EIN_EXACT": 0, "LEI_EXACT": 1, "NAME_STATE": 2}


def identity_crosswalk(spark, d):
    """Families of the identity graph, parted where a tier would join different numbers."""
    return ms.crosswalk(*_identities(spark, d), TIERS)


def _tier_sql(i, tier):
    """One tier: reachability over its edges between families, with conflicting clusters kept to unknown families."""
    return f"""k{i} AS (SELECT family, max(identifier) known FROM n{i} GROUP BY 1),
e{i} AS (SELECT DISTINCT least(x.family, y.family) x, greatest(x.family, y.family) y FROM edges JOIN n{i} x ON x.node = a JOIN n{i} y ON y.node = b WHERE edges.tier = '{tier}' AND x.family <> y.family),
f{i} AS (SELECT e{i}.*, a.known kx, b.known ky FROM e{i} JOIN k{i} a ON a.family = x JOIN k{i} b ON b.family = y WHERE a.known IS NULL OR b.known IS NULL OR a.known = b.known),
s{i} AS (SELECT x, y FROM f{i} UNION SELECT y, x FROM f{i}), r{i} AS (SELECT DISTINCT x AS family, x AS spot FROM s{i} UNION SELECT r{i}.family, s{i}.y FROM r{i} JOIN s{i} ON s{i}.x = r{i}.spot),
c{i} AS (SELECT family, min(spot) component FROM r{i} GROUP BY 1), z{i} AS (SELECT component, count(DISTINCT known) > 1 bad FROM c{i} JOIN k{i} USING (family) GROUP BY 1),
t{i} AS (SELECT x, y FROM f{i} JOIN c{i} ON c{i}.family = x JOIN z{i} USING (component) WHERE bad AND kx IS NULL AND ky IS NULL), tt{i} AS (SELECT x, y FROM t{i} UNION SELECT y, x FROM t{i}),
q{i} AS (SELECT DISTINCT x AS family, x AS spot FROM tt{i} UNION SELECT q{i}.family, tt{i}.y FROM q{i} JOIN tt{i} ON tt{i}.x = q{i}.spot),
v{i} AS (SELECT family, component AS "to" FROM c{i} JOIN z{i} USING (component) WHERE NOT bad UNION ALL SELECT family, min(spot) FROM q{i} GROUP BY 1),
n{i + 1} AS (SELECT node, coalesce("to", n{i}.family) AS family, identifier, coalesce(tier, CASE WHEN "to" IS NOT NULL THEN '{tier}' END) AS tier FROM n{i} LEFT JOIN v{i} ON v{i}.family = n{i}.family)"""


CROSSWALK = f"""WITH RECURSIVE n0 AS (SELECT c_custkey AS node, c_custkey AS family, CASE WHEN c_custkey % 4 = 1 THEN 'E' || (c_custkey // 8) WHEN c_custkey % 12 = 2 THEN 'X' || c_custkey END identifier, NULL::VARCHAR AS tier FROM customer),
g AS (SELECT (c_custkey // 4) * 4 + 1 a, c_custkey b, 'EIN_EXACT' AS tier FROM customer WHERE c_custkey % 4 = 2 AND c_custkey % 3 <> 0 UNION ALL SELECT (c_custkey // 4) * 4, c_custkey, 'LEI_EXACT' FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT greatest(c_custkey - 3, 1), c_custkey, 'NAME_STATE' FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 3),
edges AS (SELECT g.* FROM g SEMI JOIN customer ON a = c_custkey), {", ".join(_tier_sql(i, t) for i, t in enumerate(("EIN_EXACT", "LEI_EXACT", "NAME_STATE")))}
SELECT node, family, CASE WHEN count(*) OVER (PARTITION BY family) > 1 THEN tier END tier FROM n3"""

SQL = {"master_dedup": DEDUPED, "master_merges": MERGES, "identity_crosswalk": CROSSWALK}
QUERIES = {name: globals()[name] for name in SQL}
