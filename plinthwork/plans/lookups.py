"""Indexed text search over documents, and the best reference row by place and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import fulltext as ft
from plinthwork.operators import relational as rel
from plinthwork.plans.matching import _stem_sql
from plinthwork.plans.scorecards import R


def _queries(spark, d, n):
    """The first words of each benchmark passage, as queries."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(words, 1, n), " ").alias("asked"))


def indexed_search(spark, d):
    """Ten best documents for the first two words of each benchmark passage."""
    path = ft.build(table(spark, d, "documents"))
    found = ft.search(spark, path, _queries(spark, d, 2)).withColumn("rank", rounded("rank", 6))
    return rel.top_k_by(found, ["query"], [F.desc("rank"), F.asc("doc")], 10, "place").withColumn("place", F.col("place").cast("long"))


def phrase_search(spark, d):
    """Documents that hold the first five words of a benchmark passage one after the other."""
    path = ft.build(table(spark, d, "documents"))
    return ft.search(spark, path, _queries(spark, d, 5), phrase=True).select("query", "doc", "hits", rounded("rank", 6).alias("rank"))


_STOP = ", ".join(f"'{w}'" for w in ft.STOP)
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


def _terms_sql(key, source, words):
    return f"SELECT {key}, i AS place, {_stem_sql('w')} AS term FROM (SELECT {key}, unnest({words}) AS w, generate_subscripts({words}, 1) AS i FROM {source}) WHERE w NOT IN ({_STOP})"


def _search_sql(n):
    return f"""tt AS ({_terms_sql('doc_id', 'documents', _WORDS)}), po AS (SELECT term, doc_id AS doc, list_sort(list(place)) places FROM tt GROUP BY 1, 2),
qq AS (SELECT item_id AS query, term, min(place) slot FROM ({_terms_sql('item_id', 'benchmark', f'list_slice({_WORDS}, 1, {n})')}) GROUP BY 1, 2), qs AS (SELECT query, count(*) terms, min(slot) AS first FROM qq GROUP BY 1),
me AS (SELECT query, doc, terms, places, slot - first AS shift FROM po JOIN qq USING (term) JOIN qs USING (query)),
fo AS (SELECT query, doc, terms, sum(len(places))::BIGINT hits, sum(list_sum(list_transform(range(1, len(places) + 1), lambda j: 1.0::DOUBLE / (j * j)))) total, list(list_transform(places, lambda p: p - shift)) starts FROM me GROUP BY 1, 2, 3 HAVING count(*) = terms)"""


_RANK = R("total * 0.1::DOUBLE / 1.64493406685::DOUBLE / terms", 6)
INDEXED = f"WITH {_search_sql(2)}, r AS (SELECT query, doc, hits, {_RANK} AS rank FROM fo) SELECT query, doc, hits, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank DESC, doc) place FROM r) WHERE place <= 10"
PHRASES = f"WITH {_search_sql(5)} SELECT query, doc, hits, {_RANK} AS rank FROM fo WHERE len(list_reduce(starts, lambda a, b: list_intersect(a, b))) > 0"


def size_by_revenue(spark, d):
    """Workers of a customer by revenue over the ratio of the most specific row: county before state before nation, the longest code."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    code = F.when(k % 10 != 0, F.format_string("%d%d%d", k % 5 + 31, k % 7, k % 3))
    c = table(spark, d, "customer").select("c_custkey", code.alias("code"), F.col("c_nationkey").cast("string").alias("state"), F.concat("c_nationkey", F.lit("|"), k % 4).alias("county")).join(o, k == F.col("o_custkey"))
    levels = [("county", F.col("county")), ("state", F.col("state")), ("national", F.lit("US"))]
    ratios = None
    for level, place in levels:
        for n in (4, 3, 2):
            g = c.where(F.length("code") >= n).groupBy(place.alias("place"), F.substring("code", 1, n).alias("key")).agg((F.sum("revenue") / F.sum("n")).alias("ratio"), F.count(F.lit(1)).alias("m")).where("m >= 6").select(F.lit(level).alias("level"), "place", "key", "ratio")
            ratios = g if ratios is None else ratios.unionByName(g)
    best = rel.most_specific(c, ["c_custkey"], levels, "code", (4, 3, 2), ratios, ("level", "place", "key"), "ratio > 0")
    return c.join(best, "c_custkey").select("c_custkey", "level", "key", rounded("ratio", 2).alias("ratio"), F.floor(F.col("revenue") / F.col("ratio") + 0.5).cast("long").alias("workers"))


REVENUE = f"""WITH o AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE revenue, count(*) n FROM orders GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey % 5 + 31) || '' || (c_custkey % 7) || (c_custkey % 3) END code, c_nationkey::VARCHAR state, c_nationkey || '|' || (c_custkey % 4) county, revenue, n FROM customer JOIN o ON c_custkey = o_custkey),
r AS ({" UNION ALL ".join(f"SELECT '{level}' AS level, {place} AS place, substr(code, 1, {n}) AS key, sum(revenue) / sum(n) ratio FROM c WHERE length(code) >= {n} GROUP BY 1, 2, 3 HAVING count(*) >= 6" for level, place in (("county", "county"), ("state", "state"), ("national", "'US'")) for n in (4, 3, 2))})
SELECT c_custkey, b.level, b.key, {R('b.ratio', 2)} ratio, floor(revenue / b.ratio + 0.5)::BIGINT workers FROM c, LATERAL (SELECT * FROM r WHERE ratio > 0 AND code IS NOT NULL AND key IN (substr(code, 1, 4), substr(code, 1, 3), substr(code, 1, 2)) AND ((level = 'county' AND place = county) OR (level = 'state' AND place = state) OR level = 'national')
ORDER BY CASE level WHEN 'county' THEN 1 WHEN 'state' THEN 2 ELSE 3 END, length(key) DESC LIMIT 1) b"""

SQL = {"indexed_search": INDEXED, "phrase_search": PHRASES, "size_by_revenue": REVENUE}
QUERIES = {name: globals()[name] for name in SQL}
