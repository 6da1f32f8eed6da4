"""Contents and sections of contract texts that are composed from each customer's key.

Numbers and titles, styles of headings and of contents lines, wrapped titles, wrong pages, sub-entries and lengths
vary with the key. The twin never parses a text: it knows entries and places from the composition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.storage import table
from plinthwork.functions.numbers import rounded
from plinthwork.operators import contents as ct
from plinthwork.operators import textmining as tm
from plinthwork.plans.scorecards import R

TITLES = "Union Recognition;Hours of Work;Wage Rates;Paid Holidays;Grievance Procedure;Seniority Rights;Civil Leave;Health Insurance;Final Provisions".split(";")
ROMAN = "I II III IV V VI".split()
SENTENCE = "It is agreed that both sides meet and confer on Hours of Work in good faith. "
_PICK = "element_at(array({}), cast({} as int))"
_TITLE = _PICK.format(", ".join(f"'{t}'" for t in TITLES), "(k + 2 * j) % 9 + 1")
_ROMAN = _PICK.format(", ".join(f"'{r}'" for r in ROMAN), "j")


def _texts(spark, d):
    """``k, text, spans``: a cover, the contents, then one page an article."""
    printed = "if(k % 6 = 1 and j = 2, 7, j)"
    name = f"if(k % 2 = 0, concat('ARTICLE ', {_ROMAN}, ' '), concat(j, '. '))"
    title = f"if(k % 7 = 3 and j = 2, replace({_TITLE}, ' ', '\\n      '), {_TITLE})"
    line = f"concat({name}, {title}, ' ........ ', {printed}, '\\n', if(k % 5 = 0 and j = 1, concat('   1. Special Terms ..... ', {printed}, '\\n'), ''))"
    heading = f"case k % 3 when 0 then concat('ARTICLE ', {_ROMAN}, ' - ', upper({_TITLE})) when 1 then concat(j, '. ', {_TITLE}) else concat('Article ', j, ': ', {_TITLE}) end"
    body = f"concat({heading}, '\\n', repeat('{SENTENCE}', cast(1 + (k * j) % 5 as int)), '\\n', if(k % 5 = 0 and j = 1, '1. Special Terms\\nThey hold as well.\\n', ''))"
    each = "transform(sequence(1L, 3 + k % 4), j -> {})"
    pages = f"concat(array(concat('Agreement number ', k, '\\n'), concat('TABLE OF CONTENTS\\n\\n', array_join({each.format(line)}, ''))), {each.format(body)})"
    spans = "transform(sequence(1, size(pages)), i -> named_struct('page', i, 'start', aggregate(slice(pages, 1, i - 1), 0, (a, p) -> a + length(p)), 'end', aggregate(slice(pages, 1, i), 0, (a, p) -> a + length(p))))"
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("pages", F.expr(pages)).select("k", F.array_join("pages", "").alias("text"), F.expr(spans).alias("spans"))


def contents_entries(spark, d):
    """Entries of each text's contents, in order."""
    found = ct.with_sections(_texts(spark, d)).select("k", F.posexplode("entries").alias("place", "e"))
    return found.select("k", F.col("place").cast("long").alias("place"), "e.number", "e.title", F.col("e.page").cast("long").alias("page"), F.col("e.level").cast("long").alias("level"), "e.parent")


def contract_sections(spark, d):
    """Sections of each text with their places and pages."""
    found = ct.with_sections(_texts(spark, d)).select("k", F.explode("sections").alias("s"))
    return found.select("k", "s.number", "s.title", "s.parent", *[F.col(f"s.{c}").cast("long").alias(n) for c, n in (("start", "begins"), ("end", "ends"), ("page_start", "first_page"), ("page_end", "last_page"))])


def _list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_ROWS = f"""c AS (SELECT c_custkey k, 3 + c_custkey % 4 n FROM customer), a AS (SELECT k, n, j, {_list(TITLES)}[(k + 2 * j) % 9 + 1] title, {_list(ROMAN)}[j] rom, CASE WHEN k % 6 = 1 AND j = 2 THEN 7 ELSE j END printed, k % 5 = 0 AND j = 1 sub FROM c, range(1, 7) g(j) WHERE j <= n)"""
ENTRIES = f"""WITH {_ROWS}, e AS (SELECT k, j * 2 o, j::VARCHAR AS number, title, printed, 1 AS level, NULL AS parent FROM a UNION ALL SELECT k, 3, '1.1', 'Special Terms', printed, 2, '1' FROM a WHERE sub)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS place, number, title, printed::BIGINT AS page, level::BIGINT AS level, parent FROM e"""
SECTIONS = f"""WITH {_ROWS}, l AS (SELECT *, length(CASE k % 2 WHEN 0 THEN 'ARTICLE ' || rom || ' ' ELSE j || '. ' END) + length(title) + CASE WHEN k % 7 = 3 AND j = 2 THEN 6 * (len(string_split(title, ' ')) - 1) ELSE 0 END + length(' ........ ' || printed) + 1 + CASE WHEN sub THEN length('   1. Special Terms ..... ' || printed) + 1 ELSE 0 END line,
length(CASE k % 3 WHEN 0 THEN 'ARTICLE ' || rom || ' - ' WHEN 1 THEN j || '. ' ELSE 'Article ' || j || ': ' END) + length(title) + 1 + {len(SENTENCE)} * (1 + (k * j) % 5) + 1 main FROM a),
p AS (SELECT *, length('Agreement number ' || k) + 1 + {len("TABLE OF CONTENTS") + 2} + sum(line) OVER (PARTITION BY k) + coalesce(sum(main + CASE WHEN sub THEN {len("1. Special Terms") + len("They hold as well.") + 2} ELSE 0 END) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) begins FROM l),
s AS (SELECT k, j::VARCHAR AS number, title, NULL AS parent, begins, j + 2 AS page, main + CASE WHEN sub THEN {len("1. Special Terms") + len("They hold as well.") + 2} ELSE 0 END size FROM p UNION ALL SELECT k, '1.1', 'Special Terms', '1', begins + main, 3, {len("1. Special Terms") + len("They hold as well.") + 2} FROM p WHERE sub)
SELECT k, number, title, parent, begins::BIGINT AS begins, coalesce(lead(begins) OVER (PARTITION BY k ORDER BY begins), max(begins + size) OVER (PARTITION BY k))::BIGINT AS ends, page::BIGINT AS first_page, page::BIGINT AS last_page FROM s"""

#: Rules of three categories: headings that speak for or against one, texts that rule it out, and what is looked for.
RULES = {
    "wages": {"signals": [("wage", 0.6), ("rates?", 0.2)], "exclusions": ["grievance"], "negatives": ["no increase"], "patterns": [("raise", "increase", r"shall be increased", 0.80), ("hourly", "rate", r"\$\d+", 0.55)]},
    "leave": {"signals": [("leave", 0.4), ("holidays?", 0.3)], "patterns": [("days", "time_off", r"\d+ days", 0.70), ("may", "discretion", "may grant", 0.60)]},
    "hours": {"signals": [("hours", 0.5)], "exclusions": ["seniority"], "patterns": [("week", "hours", "hours a week", 0.97)]},
}
_PARTS = ("Pay shall be increased by $2 an hour", "The employer may grant 12 days of leave", "The week has 40 hours a week", "There is no increase of $5 here")


def paragraph_rules(spark, d):
    """Rules over the paragraphs of composed sections; fragments are joined to their paragraph first."""
    k, j = F.col("o_orderkey"), F.col("o_custkey")
    long_ = ", which both sides have agreed upon after a long talk about it in good faith"
    pick = lambda i: F.element_at(F.array(*[F.lit(x) for x in _PARTS]), (((k + i * j) % 4) + 1).cast("int"))
    text = F.concat(pick(0), F.lit(long_ + ".\n\n"), F.when(k % 3 == 0, "and this goes on.\n\n").otherwise(""), pick(1), F.lit(long_ + "."))
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (k % 9 + 1).cast("int"))
    o = table(spark, d, "orders").select(k.alias("o_orderkey"), text.alias("text"), title.alias("title"), F.when(k % 2 == 0, F.element_at(F.array(*[F.lit(t) for t in TITLES]), (j % 9 + 1).cast("int"))).alias("parent"))
    found = tm.categorised(ct.whole_paragraphs(o, ["o_orderkey", "title", "parent"], "text"), RULES, "paragraph", "title", "parent")
    return found.select("o_orderkey", F.col("start").cast("long").alias("begins"), "category", "class", "rule", rounded("confidence").alias("confidence"), "modal", F.length("matched").cast("long").alias("size"))


_SCORE = lambda *ps: "greatest(" + ", ".join("least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN regexp_matches(lower(coalesce({h}, '')), '{p}') THEN {w}::DOUBLE ELSE 0 END" for p, w in ps) + ")" for h in ("title", "parent")) + ")"
_ADJUST = lambda s: f"CASE WHEN {s} >= 0.5 THEN 0.05 WHEN {s} >= 0.3 THEN 0.0 ELSE -0.15 END::DOUBLE"
_NOT = lambda p: f"NOT (contains(lower(coalesce(title, '')), '{p}') OR contains(lower(coalesce(parent, '')), '{p}'))"
_LONG = ", which both sides have agreed upon after a long talk about it in good faith"
_LIST = "[" + ", ".join(f"'{x}'" for x in _PARTS) + "]"
PARAGRAPH_RULES = f"""WITH o AS (SELECT o_orderkey, {_list(TITLES)}[o_orderkey % 9 + 1] title, CASE WHEN o_orderkey % 2 = 0 THEN {_list(TITLES)}[o_custkey % 9 + 1] END parent, {_LIST}[o_orderkey % 4 + 1] || '{_LONG}.' a, {_LIST}[(o_orderkey + o_custkey) % 4 + 1] || '{_LONG}.' b FROM orders),
p AS (SELECT o_orderkey, title, parent, 0 begins, a || CASE WHEN o_orderkey % 3 = 0 THEN ' and this goes on.' ELSE '' END t FROM o UNION ALL SELECT o_orderkey, title, parent, length(a) + 2 + CASE WHEN o_orderkey % 3 = 0 THEN 19 ELSE 0 END, b FROM o),
s AS (SELECT *, {_ADJUST(_SCORE(("wage", 0.6), ("rates?", 0.2)))} w, {_ADJUST(_SCORE(("leave", 0.4), ("holidays?", 0.3)))} l, {_ADJUST(_SCORE(("hours", 0.5)))} h, {_NOT("grievance")} AND NOT contains(t, 'no increase') ow, {_NOT("seniority")} oh FROM p),
m AS (SELECT *, 'wages' category, 'increase' AS "class", 'raise' AS rule, 0.80::DOUBLE + w c FROM s WHERE ow AND contains(t, 'shall be increased') UNION ALL SELECT *, 'wages', 'rate', 'hourly', 0.55::DOUBLE + w FROM s WHERE ow AND regexp_matches(t, '\\$\\d+')
UNION ALL SELECT *, 'leave', 'time_off', 'days', 0.70::DOUBLE + l FROM s WHERE regexp_matches(t, '\\d+ days') UNION ALL SELECT *, 'leave', 'discretion', 'may', 0.60::DOUBLE + l FROM s WHERE contains(t, 'may grant') UNION ALL SELECT *, 'hours', 'hours', 'week', 0.97::DOUBLE + h FROM s WHERE oh AND contains(t, 'hours a week'))
SELECT o_orderkey, begins::BIGINT AS begins, category, "class", rule, {R('least(0.99::DOUBLE, c)')} confidence, (CASE WHEN contains(t, 'shall') THEN 0.90 WHEN contains(t, 'may') THEN 0.40 ELSE 0.50 END)::DOUBLE modal, length(t)::BIGINT AS size FROM m WHERE least(0.99::DOUBLE, c) >= 0.5"""

SQL = {"contents_entries": ENTRIES, "contract_sections": SECTIONS, "paragraph_rules": PARAGRAPH_RULES}
QUERIES = {name: globals()[name] for name in SQL}
