"""Contents, sections and fields of contracts; estimators as data; the index; scores; published versions."""

import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plinthwork.functions import text as tx
from plinthwork.operators import contents as ct
from plinthwork.operators import contracts as cn
from plinthwork.operators import estimators as es
from plinthwork.operators import filings as fl
from plinthwork.operators import fulltext as ft
from plinthwork.operators import relational as rel
from plinthwork.operators import scoring as sc
from plinthwork.sources import sinks

TITLES = ["Union Recognition", "Hours of Work", "Wages and Premium Pay", "Civil Leave"]


def contract(heading, line, wrong=None, more="", sub=False):
    """Text and page spans of a contract whose article i is headed and announced as asked."""
    lines = [line(i, t, 9 if wrong == i else i) for i, t in enumerate(TITLES, 1)]
    pages = ["COVER\n", "TABLE OF CONTENTS\n\n" + "\n".join(lines) + "\n" + more]
    for i, t in enumerate(TITLES, 1):
        pages.append(f"{heading(i, t)}\nThey speak of Civil Leave and of Hours of Work here, article {i}. " + "bla " * 40 + "\n" + ("1. Special Terms\nThey hold.\n" if sub and i == 2 else ""))
    spans, at = [], 0
    for k, p in enumerate(pages, 1):
        spans.append((k, at, at + len(p)))
        at += len(p)
    return "".join(pages), spans


HEADINGS = {"roman": lambda i, t: f"ARTICLE {ct.roman(i)} - {t.upper()}", "arabic": lambda i, t: f"{i}. {t}", "colon": lambda i, t: f"Article {i}: {t}", "bare": lambda i, t: t}
LINES = {
    "roman": lambda i, t, p: f"ARTICLE {ct.roman(i)}  {t} ........ {p}", "arabic": lambda i, t, p: f"{i}. {t} ..... {p}",
    "wrapped": lambda i, t, p: f"ARTICLE {i}  {t.split()[0]}\n     {' '.join(t.split()[1:])} ...... {p}",
}


@pytest.mark.parametrize("heading", HEADINGS)
@pytest.mark.parametrize("line", LINES)
@pytest.mark.parametrize("wrong", [None, 2])
def test_contents_and_sections(heading, line, wrong):
    text, spans = contract(HEADINGS[heading], LINES[line], wrong)
    entries = ct.contents(text)
    assert [(e.number, e.title, e.page, e.level) for e in entries] == [(str(i), t, 9 if wrong == i else i, 1) for i, t in enumerate(TITLES, 1)]
    sections = ct.split_sections(text, spans, entries)
    assert [(s.number, s.page_start, s.start) for s in sections] == [(str(i), i + 2, spans[i + 1][1]) for i in range(1, 5)]
    assert all(a.end == b.start for a, b in zip(sections, sections[1:])) and sections[-1].end == len(text)


def test_sub_entries_noise_and_what_is_no_contents():
    more = "ii\n\n- 3 -\nARTICLE II (continued)\n   1. Special Terms ..... 2\nSide Letters ...... 4\nIndex ..... 9\n"
    text, spans = contract(HEADINGS["roman"], LINES["roman"], more=more, sub=True)
    entries = ct.contents(text)
    assert [(e.number, e.level, e.parent) for e in entries[4:]] == [("2.1", 2, "2"), ("Side Letters", 1, None)]
    order = [entries[0], entries[1], entries[4], *entries[2:4]]
    assert [s.number for s in ct.split_sections(text, spans, order)] == ["1", "2", "2.1", "3", "4"]
    assert ct.contents(None) == [] and ct.contents("no contents at all") == [] and ct.split_sections("text", [], []) == []
    cluster = "\n".join(f"Title Number {i} ...... {i}" for i in range(1, 7)) + "\n" + "word " * 600
    assert len(ct.contents(cluster)) == 6
    assert (ct.arabic("xiv"), ct.arabic("CIVIL"), ct.arabic("7")) == ("14", "CIVIL", "7")


def test_sections_of_a_table(spark):
    text, spans = contract(HEADINGS["arabic"], LINES["arabic"])
    rows = [(1, text, [Row(page=p, start=s, end=e) for p, s, e in spans], "x"), (2, None, None, "y"), (3, "", [], "z")]
    got = ct.with_sections(spark.createDataFrame(rows, "id long, text string, spans array<struct<page: int, start: int, end: int>>, sections string")).orderBy("id").collect()
    assert [len(r.sections) for r in got] == [4, 0, 0] and got[0].text == text and got[0].sections[0].number == "1"


def test_paragraphs_join_fragments(spark):
    long_ = "This sentence is long enough to stand as a paragraph of its own in any contract that there is."
    text = f"{long_}\n\nand this one goes on in lower case.\n\nHowever this one begins with a connecting word.\n \n  {long_} Yes\n\nShort end\n\nSECTION 3 {long_}"
    got = [(r.start, r.paragraph) for r in ct.whole_paragraphs(spark.createDataFrame([(1, text), (2, None), (3, " \n\n ")], "id long, text string"), ["id"], "text").orderBy("start").collect()]
    assert [p[:12] for _, p in got] == [long_[:12], long_[:12], "SECTION 3 Th"] and got[0][1].endswith("connecting word.") and got[1][1].endswith("Yes Short end")
    assert all(text[s:].startswith(p[:20]) for s, p in got)


FIELDS = [
    ("between the Carpenters District Council and Acme, Inc", cn.parties, {"employer": "Acme", "union": "Carpenters District Council"}), ('Entered into by "Acme Steel" and Machinists Lodge No. 7, here', cn.parties, {"employer": "Acme Steel", "union": "Machinists Lodge No"}),
    ("nothing", cn.parties, {"employer": None, "union": None}), ("Local 100A", cn.local_number, "100A"), ("Local No. 804", cn.local_number, "804"), ("Lodge No. 7", cn.local_number, "7"), ("SEIU Local 32-1B", cn.local_number, "32-1B"), ("none", cn.local_number, None),
    ("This Agreement shall be effective January 1, 2022.", cn.contract_dates, {"effective": "January 1, 2022", "expires": None}), ("for the period March 1, 2023 through February 28, 2027.", cn.contract_dates, {"effective": "March 1, 2023", "expires": "February 28, 2027"}),
    ("Effective as of 01/15/2024 and ending on 01/14/2028.", cn.contract_dates, {"effective": "01/15/2024", "expires": "01/14/2028"}), ("2022-2026 Apartment Agreement", cn.contract_dates, {"effective": "January 1, 2022", "expires": "December 31, 2026"}),
    ("covering employees in the State of New York.", cn.place_state, "New York"), ("Located in Albany, West Virginia.", cn.place_state, "West Virginia"), ("Albany", cn.place_state, None),
    ("a 3-year agreement", cn.term_years, 3), ("a 12 year term", cn.term_years, None), ("effective January 1, 2022 " + "x " * 60 + "expires December 31, 2025", cn.term_years, 4), ("April 1, 2020 and June 2, 2021 and May 1, 2023", cn.term_years, 3), ("May 1, 1990 to May 1, 1995", cn.term_years, None),
    ("New Year", cn.holidays, None), ("New Year, Easter, Juneteenth and 2 floating holidays", cn.holidays, 5), ("double time and one half", cn.holiday_rate, "2.5"), ("double time", cn.holiday_rate, "2.0"), ("nothing", cn.holiday_rate, None),
    ("overtime at time and one half", cn.overtime_rate, "1.5"), ("overtime " + "x" * 400 + " double time", cn.overtime_rate, None), ("double time", cn.overtime_rate, None), ("Step 1, Step 2, Step 4", cn.grievance_steps, 4), ("a 3-step grievance", cn.grievance_steps, 3), ("Step 1", cn.grievance_steps, None),
    ("probation of sixty (60) calendar days", cn.probation_days, 60), ("within 3 months of probation", cn.probation_days, 90), ("5 days of probation", cn.probation_days, None), ("60 days", cn.probation_days, None), ("no Lockout", cn.no_strike, True),
    ("The bargaining unit shall consist of all full-time building service employees here.", cn.bargaining_unit, "of all full-time building service employees here"), ("", cn.bargaining_unit, None),
]


def test_contract_fields(spark):
    by = {}
    for text, f, want in FIELDS:
        by.setdefault(f, []).append((text, want))
    for f, cases in by.items():
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(99, None)], "i int, t string")
        got = {r.i: r.v.asDict() if isinstance(r.v, Row) else r.v for r in df.select("i", f("t").alias("v")).collect()}
        assert [got[i] for i in range(len(cases))] == [w for _, w in cases], f.__name__
        assert not (any(got[99].values()) if isinstance(got[99], dict) else got[99])


def test_estimators_are_rows(spark):
    signals = spark.createDataFrame([(1, "race", "a", "x", 60.0), (1, "race", "a", "y", 40.0), (1, "race", "b", "x", 20.0), (1, "race", "b", "y", 80.0), (2, "race", "a", "x", 50.0), (2, "race", "a", "y", 50.0), (3, "race", "b", "y", None), (4, "other", "a", "x", 1.0)], "entity long, dimension string, signal string, category string, value double")
    entities = spark.createDataFrame([(1, ["big"]), (2, []), (4, None)], "entity long, classes array<string>")
    part = lambda *a, **k: es.Part(a[0], "race", *a[1:], **k)
    config = [part("blend", 0, "blend", "a", 0.6), part("blend", 0, "blend", "b", 0.4), part("product", 0, "product", "a", 1), part("product", 0, "product", "b", 1), part("need", 0, "blend", "b", 1, required=True), part("need", 1, "blend", "a", 1), part("class", 0, "blend", "b", 1, when="big"), part("class", 1, "blend", "a", 1)]
    got = {(r.entity, r.method, r.category): round(r.value, 6) for r in es.estimate(signals, entities, config).collect()}
    assert got == {
        (1, "blend", "x"): 44.0, (1, "blend", "y"): 56.0, (1, "product", "x"): round(1200 / 44, 6), (1, "product", "y"): round(3200 / 44, 6), (1, "need", "x"): 20.0, (1, "need", "y"): 80.0, (1, "class", "x"): 20.0, (1, "class", "y"): 80.0,
        (2, "blend", "x"): 50.0, (2, "blend", "y"): 50.0, (2, "need", "x"): 50.0, (2, "need", "y"): 50.0, (2, "class", "x"): 50.0, (2, "class", "y"): 50.0,
    }
    with pytest.raises(ValueError, match="differ"):
        es.estimate(signals, entities, [*config, part("class", 0, "product", "a", 1)])
    weights = [r[0] for r in spark.createDataFrame([(None,), (0.2,), (0.5,), (1.0,), (1.5,), (2.5,)], "q double").select(es.adaptive_weight("q")).collect()]
    assert weights == [0.5, 0.65, 0.5, 0.45, 0.35, 0.3]


def test_index_and_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The workers of the union meet"), (2, "Union workers, union halls"), (3, None), (4, "the of and"), (None, "union")], "doc_id long, text string")
    path = ft.build(docs, path=f"file://{tmp_path}/index")
    queries = spark.createDataFrame([("q1", "union workers"), ("q2", "the of"), ("q3", "halls missing"), ("q4", "workers of the union")], "query string, asked string")
    got = {(r.query, r.doc): r.hits for r in ft.search(spark, path, queries).collect()}
    assert got == {("q1", 1): 2, ("q1", 2): 3, ("q4", 1): 2, ("q4", 2): 3}
    assert {(r.query, r.doc) for r in ft.search(spark, path, queries, phrase=True).collect()} == {("q1", 2), ("q4", 1)}
    plan = ft.search(spark, path, queries)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_the_most_specific_row(spark):
    rows = spark.createDataFrame([(1, "31123", "NY", "NY-1"), (2, "31999", "NY", "NY-2"), (3, "99", "OH", None), (4, None, "NY", "NY-1"), (5, "3112", None, None)], "id long, code string, state string, county string")
    ref = spark.createDataFrame([("county", "NY-1", "31", 1.0), ("state", "NY", "3112", 2.0), ("state", "NY", "319", 3.0), ("national", "US", "3112", 4.0), ("national", "US", "99", 0.0)], "level string, place string, code string, v double")
    got = {r.id: (r.level, r.v) for r in rel.most_specific(rows, ["id"], [("county", F.col("county")), ("state", F.col("state")), ("national", F.lit("US"))], "code", (4, 3, 2), ref, ("level", "place", "code"), "v > 0").collect()}
    assert got == {1: ("county", 1.0), 2: ("state", 3.0), 5: ("national", 4.0)}


def test_scores_of_rows_with_little_or_nothing(spark):
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in "abcdefgh"], F.lit(None).cast("date").alias("day"))
    day = F.to_date(F.lit("2001-08-01"))
    got = none.select(
        sc.violations("a", "b", "c", "d", "day", "e", day).alias("v"), sc.organizing("a", "b", "c", "day", "d", "day", "e", "f", day).alias("o"), sc.anger("a", "b", "c", "d").alias("n"), sc.leverage("a", "b", "c", "d", "e").alias("l"),
        sc.violations(F.lit(1), F.lit(0), F.lit(0), F.lit(2), "day", F.lit(None).cast("double"), day).alias("v1"), sc.organizing(F.lit(None), F.lit(None), F.lit(None), "day", F.lit(3), "day", F.lit(60), F.lit(1), day).alias("o1"),
        sc.anger(F.lit(4.0), "a", "b", F.lit(1), F.lit(0.2)).alias("n1"), sc.leverage("a", "b", F.lit(8.0), "c", "d", F.lit(600_000)).alias("l1"), sc.tier(F.lit(0.99), F.lit(2), F.lit(0)).alias("t"),
        sc.implausible(F.lit(-1), "a", {"gender": F.array(F.lit(48.5), F.lit(49.0))}).alias("w"), sc.implausible(F.lit(200_000_000), "a", {"gender": F.array(F.lit(50.0), F.lit(53.5))}).alias("w2"),
    ).first()
    assert (got.v, got.o, got.n, got.l) == (None,) * 4
    assert got.v1 == round(3.5 / 2.23, 2) + 1 and got.o1 == 6.5 and abs(got.n1 - (12 + 16 + 2) / 7) < 1e-9 and got.l1 == min(10, 210 / 25) and got.t == "Speculative"
    assert got.w == ["total_workers must be > 0"] and got.w2 == ["total_workers exceeds ceiling", "gender pct sum outside"]


def test_folding_is_that_of_compatibility_decomposition(spark):
    import unicodedata

    texts = ["Café Ünion", "ﬁne oﬃce", "Łódź", "½ price", "ＡＢＣ", "ẞ Ǆ", "plain", "日本 co", "", "Ｉｎｃ．"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.ascii_fold("t")).collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_two_publishers_at_once_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    sinks.publish(spark.range(1), root)
    kept = sinks._pointers(spark, root)
    sinks.publish(spark.range(2), root, after=max(kept))
    with pytest.raises(sinks.Superseded):
        sinks.publish(spark.range(3), root, after=max(kept))
    assert sinks.current(spark, root).count() == 2
    base = spark.createDataFrame([(0, 0, 0)], "id long, v long, t long")
    sinks.publish(base, root)
    jobs = [threading.Thread(target=sinks.merge, args=(spark.createDataFrame([(i, i, i)], "id long, v long, t long"), root, ["id"], "t")) for i in (1, 2, 3)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert {r.id for r in sinks.current(spark, root).collect()} == {0, 1, 2, 3}


NAMES = ["Jane Q. Doe", "Adam Portnoy", "Mary Ann de la Cruz", "Thomas E. Capasse Jr.", "Bo Li"]


def test_grids_spread_spans_and_keep_nested_tables_apart(spark):
    html = "<table><tr><td rowspan=2>a<td colspan=2>b</tr><tr><td>c<td><table><tr><td>in</table></tr></table>"
    tables = fl.read_html(html).all("table")
    assert fl.grid(tables[0]) == [["a", "b", "b"], ["a", "c", "in"]] and fl.grid(tables[1]) == [["in"]]
    assert fl.grid(fl.read_html("<table></table>").all("table")[0]) == [] and fl.read_html(None).all("table") == []
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "id long, html string")
    got = sorted(map(tuple, fl.table_cells(pages, "id", "html").collect()))
    assert got[:3] == [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 0, 0, 2, "b")] and len(got) == 7


def test_directors_of_each_shape():
    small = "".join(f"<table><tr><td></td></tr><tr><td>{n} age {50 + i} director since {2000 + i} Independent. Audit Committee</td></tr></table>" for i, n in enumerate(NAMES))
    summary = "<table><tr><td></td></tr><tr><th>Name<th>Age<th>Year First Elected<th>Independent</tr>" + "".join(f"<tr><td>Mr. {n} (3)<td>{50 + i}<td>{2000 + i}<td>X</tr>" for i, n in enumerate(NAMES)) + "<tr><td>Total<td>9<td>9<td></tr></table>"
    text = "<p>Directors: " + " ".join(f"{n} (age {50 + i}) has led firms. Director since {2000 + i}." for i, n in enumerate(NAMES)) + "</p>"
    beside = "<table>" + "".join(f"<tr><td>{n} President</td><td>Age: {50 + i} Director Since: May {2000 + i} Independent: No and more words to fill it up</td></tr>" for i, n in enumerate(NAMES)) + "</table>" + "<table><tr><td>x</td></tr></table>" * 2
    heads = "".join(f"<h3>{n}</h3><div>Age: {50 + i} Director Since: {2000 + i} and more words to fill this block up</div>" for i, n in enumerate(NAMES))
    plain = [n.rstrip(".") for n in NAMES]
    for html, shape in ((small, "small_table"), (summary, "summary"), (text, "paragraph"), (beside, "block"), (heads, "block")):
        got = fl.directors(html)
        assert [(d.name, d.age, d.since, d.shape) for d in got] == [(n, 50 + i, 2000 + i, shape) for i, n in enumerate(plain)], shape
    fees = "<table><tr><th>Name<th>Fees Earned<th>Total</tr>" + "".join(f"<tr><td>{n}<td>50,000<td>${i + 1}00,500</tr>" for i, n in enumerate(NAMES)) + "</table>"
    merged = fl.directors(text + fees)
    assert [(d.name, d.age, d.compensation) for d in merged] == [(n, 50 + i, (i + 1) * 100_000 + 500.0) for i, n in enumerate(plain)]
    assert [d.shape for d in fl.directors(fees)] == ["compensation"] * 5 and fl.directors("") == [] and fl.directors(None) == []


def test_names_that_no_person_has_are_left_out(spark):
    filings = spark.createDataFrame([(1, "<p>Audit Committee (age 50) and then Bo Li (age 61) came.</p>"), (2, None), (3, "")], "id long, html string")
    assert [(r.id, r.name, r.age) for r in fl.filed_directors(filings, "id", "html").collect()] == [(1, "Bo Li", 61)]
