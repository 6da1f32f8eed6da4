"""Text-mining queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import table
from plinthwork.operators import textmining as tm
from plinthwork.plans.scorecards import R


def html_extract(spark, d):
    """Title, language, links, paragraphs and clean text of each page."""
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r'<html lang="([^"]*)"', 1).alias("lang"), F.regexp_count(h, F.lit(r"<a\s+href=")).cast("long").alias("links"),
        F.array_join(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1)), " ").alias("targets"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), F.sha2(tm.html_text("html"), 256).alias("text_sha256"),
    )


HTML = r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a\s+href='))::BIGINT links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') targets, len(regexp_extract_all(html, '<p>'))::BIGINT paragraphs,
sha256(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) text_sha256 FROM pages"""


def _clauses(spark, d):
    """Order lines worded as contract clauses: the public tables hold no contracts."""
    l = table(spark, d, "lineitem")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("shall pay", "must not exceed", "will give", "may grant")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(F.lit("The Employer "), verb, F.lit(" wages of $"), F.format_string("%,.2f", F.col("l_extendedprice")), F.lit(" per hour and "), F.col("l_quantity").cast("int").cast("string"), F.lit("% overtime within thirty ("), (F.col("l_linenumber") * 10).cast("string"), F.lit(") days."))
    return l.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), text.alias("text"), F.when(F.col("l_returnflag") == "R", "Grievance Procedure").when(F.col("l_returnflag") == "A", "Wages and Hours").alias("heading"))


CLAUSES = """c AS (SELECT l_orderkey, l_linenumber::BIGINT line, 'The Employer ' || ['shall pay', 'must not exceed', 'will give', 'may grant'][l_linenumber % 4 + 1] || ' wages of $' || format('{:,.2f}', l_extendedprice) || ' per hour and ' || l_quantity::INT || '% overtime within thirty (' || (l_linenumber * 10) || ') days.' AS text, CASE l_returnflag WHEN 'R' THEN 'Grievance Procedure' WHEN 'A' THEN 'Wages and Hours' END heading FROM lineitem)"""


def value_extract(spark, d):
    v = _clauses(spark, d).withColumn("v", tm.values("text"))
    return v.select("l_orderkey", "line", *[F.array_join(f"v.{k}", ";").alias(k) for k in ("dollars", "percents", "days", "periods")], tm.modal_weight("text").alias("modal"))


VALUES = rf"""WITH {CLAUSES} SELECT l_orderkey, line, replace(array_to_string(regexp_extract_all(text, '\$\s*([\d,]+(?:\.\d{{1,2}})?)', 1), ';'), ',', '') dollars, array_to_string(regexp_extract_all(lower(text), '(\d+(?:\.\d+)?)\s*(?:%|percent\b)', 1), ';') percents, array_to_string(regexp_extract_all(lower(text), '(\d+)\s*\)?\s*(?:calendar|working|business)?\s*days?\b', 1), ';') AS days, array_to_string(regexp_extract_all(lower(text), '\b(hourly|daily|weekly|monthly|annually|per hour|per week|per month|per year)\b', 1), ';') periods,
(CASE WHEN regexp_matches(lower(text), '\bshall not\b|\bmust not\b') THEN 0.95 WHEN regexp_matches(lower(text), '\bshall\b|\bmust\b') THEN 0.9 WHEN regexp_matches(lower(text), '\bwill\b') THEN 0.8 WHEN regexp_matches(lower(text), '\bmay\b') THEN 0.4 ELSE 0.5 END)::DOUBLE modal FROM c"""

RULES = [("wages", r"\bwages of \$", 0.80, "wages"), ("overtime", r"\bovertime\b", 0.60, "hours"), ("limits", r"\bmust not exceed\b", 0.90, None), ("discretion", r"\bmay grant\b", 0.45, None)]


def rule_classify(spark, d):
    found = tm.classify(_clauses(spark, d), RULES, "text", "heading")
    return found.select("l_orderkey", "line", "class", rounded("confidence").alias("confidence"), "modal")


def _rules_sql():
    parts = []
    for name, pattern, conf, near in RULES:
        adjust = f" + CASE WHEN heading IS NULL THEN 0.0 WHEN regexp_matches(lower(heading), '{near}') THEN 0.05::DOUBLE ELSE -0.15::DOUBLE END" if near else ""
        parts.append(f"SELECT l_orderkey, line, '{name}' AS class, {conf}::DOUBLE{adjust} cf, text FROM c WHERE regexp_matches(lower(text), '{pattern}')")
    modal = r"(CASE WHEN regexp_matches(lower(text), '\bshall not\b|\bmust not\b') THEN 0.95 WHEN regexp_matches(lower(text), '\bshall\b|\bmust\b') THEN 0.9 WHEN regexp_matches(lower(text), '\bwill\b') THEN 0.8 WHEN regexp_matches(lower(text), '\bmay\b') THEN 0.4 ELSE 0.5 END)::DOUBLE modal"
    return f"WITH {CLAUSES}, m AS ({' UNION ALL '.join(parts)}) SELECT l_orderkey, line, class, {R('cf')} confidence, {modal} FROM m WHERE cf >= 0.5"


def doc_exact_dedup(spark, d):
    """One document a content hash, the smallest id, with the number of its copies."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return docs.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources"))


def paragraph_stats(spark, d):
    """Paragraphs of eighty characters or more with their offsets, summed up a document."""
    p = tm.paragraphs(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("starts"), F.max(F.length("paragraph")).cast("long").alias("longest"))


PARAGRAPHS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) p, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents), o AS (SELECT *, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s FROM l)
SELECT doc_id, count(*) n, sum(s)::BIGINT starts, max(length(p))::BIGINT longest FROM o WHERE length(p) >= 80 GROUP BY 1"""


def span_link(spark, d):
    """Lines of an order linked to the section of the largest overlap (sections are thirds of the order's lines)."""
    l = table(spark, d, "lineitem").select("l_orderkey", ((F.col("l_linenumber") - 1) * 100 + F.col("l_linenumber") * 7 % 50).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("q")).withColumn("end", F.col("start") + 40 + F.col("q")).drop("q").distinct()
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for i, (a, b) in enumerate([(0, 210), (210, 430), (430, 2000)])])).alias("x")).select("l_orderkey", "x.*")
    return tm.link_spans(l, s, "l_orderkey").select("l_orderkey", "start", "end", F.col("section").cast("long").alias("section"), "overlap")


SPANS = """WITH l AS (SELECT DISTINCT l_orderkey, ((l_linenumber - 1) * 100 + l_linenumber * 7 % 50)::BIGINT AS "start", ((l_linenumber - 1) * 100 + l_linenumber * 7 % 50)::BIGINT + 40 + l_quantity::BIGINT AS "end" FROM lineitem), s(section, a, b) AS (VALUES (0, 0, 210), (1, 210, 430), (2, 430, 2000)), j AS (SELECT l.*, section, a, greatest(least("end", b) - greatest("start", a), 0) AS ov FROM l JOIN orders ON l_orderkey = o_orderkey CROSS JOIN s WHERE greatest(least("end", b) - greatest("start", a), 0) > 0 OR ("start" >= a AND "start" < b))
SELECT l_orderkey, "start", "end", section::BIGINT section, ov AS "overlap" FROM (SELECT DISTINCT ON (l_orderkey, "start", "end") * FROM j ORDER BY l_orderkey, "start", "end", ov DESC, a)"""


def full_text_search(spark, d):
    """Documents that hold all the words asked for, by frequency."""
    return tm.rank_text(table(spark, d, "documents"), "doc_id", "text", ["the", "of", "with"]).select("doc_id", "hits", rounded("rank", 6).alias("rank"))


FTS = rf"""WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b')) a, len(regexp_extract_all(lower(text), '\bof\b')) b, len(regexp_extract_all(lower(text), '\bwith\b')) w, len(regexp_split_to_array(text, '\s+')) n FROM documents) SELECT doc_id, (a + b + w)::BIGINT hits, {R("(a + b + w)::DOUBLE / n", 6)} AS rank FROM c WHERE a > 0 AND b > 0 AND w > 0"""


def coverage_matrix(spark, d):
    """Every class by segment with its clauses, and what is missing."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    found = tm.classify(_clauses(spark, d), RULES, "text", "heading").join(o, F.col("l_orderkey") == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    have = found.groupBy("c_mktsegment", "class").agg(F.count(F.lit(1)).alias("n"))
    classes = spark.createDataFrame([(r[0],) for r in RULES], "class string")
    grid = c.select("c_mktsegment").distinct().crossJoin(F.broadcast(classes))  # segments by the four classes
    return grid.join(have, ["c_mktsegment", "class"], "left").select("c_mktsegment", "class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("missing"))


def _coverage_sql():
    body = _rules_sql()
    head, tail = body.split(" SELECT l_orderkey, line, class,", 1)
    classes = ", ".join(f"('{r[0]}')" for r in RULES)
    return f"{head}, h AS (SELECT c_mktsegment, class, count(*) n FROM m JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE cf >= 0.5 GROUP BY 1, 2), g AS (SELECT DISTINCT c_mktsegment, k.class FROM customer, (VALUES {classes}) k(class)) SELECT g.c_mktsegment, g.class, coalesce(n, 0) n, n IS NULL AS \"missing\" FROM g LEFT JOIN h ON g.c_mktsegment = h.c_mktsegment AND g.class = h.class"


def article_sections(spark, d):
    """Orders written out as contracts with articles, and cut again at their headings."""
    c = _clauses(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("ARTICLE "), x["line"].cast("string"), F.lit(". Terms\n"), x["text"])), "\n")
    return tm.articles(c.select("l_orderkey", text.alias("text")), "l_orderkey", "text").select("l_orderkey", "number", "title", F.length("body").cast("long").alias("n_chars"))


ARTICLES = f"WITH {CLAUSES} SELECT l_orderkey, line::VARCHAR AS number, 'Terms' title, max(length(text))::BIGINT n_chars FROM c GROUP BY 1, 2"


def overlap_dedup(spark, d):
    """Matches of an order's spans without those that a surer one covers by half."""
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 30).cast("long").alias("start"), (F.col("l_linenumber") * 30 + F.col("l_quantity")).cast("long").alias("end"), rounded("l_discount").alias("confidence"))
    return tm.drop_overlaps(l, ["l_orderkey"], "start", "end", "confidence")


def conversation_grades(spark, d):
    """Turns, sources and length a conversation, graded by weighted dimensions over what is present."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"), F.bool_or(F.col("role") == "system").alias("guided"))
    coverage, quality = F.least(F.col("turns") / 8, F.lit(1.0)), F.least(F.col("chars") / 4000, F.lit(1.0))
    grade = rounded((coverage * 0.35 + quality * 0.45 + F.col("guided").cast("double") * 0.20) * 10, 2)
    return c.select("conv_id", "turns", "roles", "chars", grade.alias("grade"), F.when(F.col("roles") >= 3, "triple").when(F.col("roles") == 2, "dual").otherwise("single").alias("triangulation"))


GRADES = f"""WITH c AS (SELECT conv_id, count(*) turns, count(DISTINCT role) roles, sum(length(text))::BIGINT chars, bool_or(role = 'system') g FROM conversations GROUP BY 1)
SELECT conv_id, turns, roles, chars, {R("(least(turns / 8.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE + least(chars / 4000.0::DOUBLE, 1.0::DOUBLE) * 0.45::DOUBLE + g::INT::DOUBLE * 0.20::DOUBLE) * 10", 2)} grade, CASE WHEN roles >= 3 THEN 'triple' WHEN roles = 2 THEN 'dual' ELSE 'single' END triangulation FROM c"""


def contradictions(spark, d):
    """Numeric facts of a customer that disagree by more than half; the newer one is flagged."""
    o = table(spark, d, "orders").where("o_totalprice > 0").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    g = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.max("o_orderkey").alias("newest"), F.count(F.lit(1)).alias("facts"))
    return g.where((F.col("facts") > 1) & (F.col("high") / F.col("low") > 1.5)).select("o_custkey", "o_orderpriority", "newest", "facts")


SQL = {
    "html_extract": HTML, "value_extract": VALUES, "rule_classify": _rules_sql(),
    "doc_exact_dedup": "SELECT sha256(text) content, min(doc_id) doc_id, count(*) copies, count(DISTINCT source) sources FROM documents GROUP BY 1",
    "paragraph_stats": PARAGRAPHS, "span_link": SPANS, "full_text_search": FTS, "coverage_matrix": _coverage_sql(), "article_sections": ARTICLES, "conversation_grades": GRADES,
    "contradictions": "SELECT o_custkey, o_orderpriority, max(o_orderkey) newest, count(*) facts FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2 HAVING count(*) > 1 AND max(o_totalprice) / min(o_totalprice) > 1.5",
}
QUERIES = {name: globals()[name] for name in SQL} | {"overlap_dedup": overlap_dedup}
