"""Unit vectors of functions and operators, on literal rows."""

import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from plinthwork.functions import numbers as nm
from plinthwork.functions import similarity as sim
from plinthwork.functions import storage
from plinthwork.functions import text as tx
from plinthwork.operators import matching as m
from plinthwork.operators import relational as rel
from plinthwork.operators import statistics as st
from plinthwork.operators import textmining as tm
from plinthwork.operators.components import connected_components
from plinthwork.sources import readers, sinks
from plinthwork.streaming import delta


def col(spark, values, f, kind="string"):
    return [r[1] for r in sorted(spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x"))).collect())]


def test_names(spark):
    std = {"WAL-MART STORES, INC.": "wal mart stores inc", "Acme LLC DBA Midtown Labs": "acme llc", "O'Brien & Sons, Ltd.": "o brien sons ltd", "": "", None: ""}
    assert col(spark, list(std), tx.standard_name) == list(std.values())
    agg = {"The Acme Services Group": "acme", "ABC Holdings USA": "abc", "ABC Svcs": "abc", "XYZ Mgmt Group": "xyz", "XYZ Enterprises International": "xyz"}
    assert col(spark, list(agg), tx.aggressive_name) == list(agg.values())
    assert col(spark, ["Café Internacional, Inc."], tx.fuzzy_name) == ["cafe internacional"]
    assert col(spark, ["Robert", "Rupert"], F.soundex) == ["R163", "R163"]
    assert col(spark, ["Thomas E. Capasse", None], tx.name_slug) == ["thomas-e-capasse", ""]
    assert col(spark, ["12 North Main Street, Suite 4", "Main"], tx.street_number) == ["12", None]
    assert col(spark, ["12 North Main Street, Suite 4"], tx.address) == ["12 n main st ste 4"]


def test_string_similarities():
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and sim.jaro_winkler("", "") == 1.0
    assert sim.indel_ratio("kitten", "sitting") == pytest.approx(61.538, abs=1e-3) and sim.indel_ratio("", "") == 100.0
    assert sim.token_sort_ratio("b a", "a b") == 100.0 and sim.token_set_ratio("a b", "a b c") == 100.0 and sim.token_set_ratio("", "a") == 0.0
    assert sim.sequence_ratio("abcd", "bcde") == 0.75 and sim.metaphone("knight")[0] == "N" and sim.metaphone("") == ""


def test_trigrams(spark):
    row = spark.createDataFrame([("word", "words"), ("", ""), (None, "x")], "a string, b string").select(sim.trigram_similarity("a", "b"), sim.bigram_jaccard("a", "b"), sim.token_overlap("a", "b")).collect()
    assert row[0][0] == pytest.approx(4 / 7) and row[0][1] == pytest.approx(3 / 4) and list(row[1]) == [0.0, 0.0, 0.0] and row[2][0] == 0.0


@pytest.mark.parametrize("years,half,factor", [(0, 10, 1.0), (1, 10, 0.933), (5, 10, 0.707), (10, 10, 0.5), (20, 10, 0.25), (-5, 10, 1.0), (7, 7, 0.5), (14, 7, 0.25)])
def test_decay(spark, years, half, factor):
    as_of = F.to_date(F.lit("2020-01-01"))
    got = spark.range(1).select(nm.decay(as_of, F.date_sub(as_of, int(years * 365.25)), float(half)), nm.decay(as_of, F.lit(None).cast("date"), 5.0)).first()
    assert got[0] == pytest.approx(factor, abs=1e-3) and got[1] == 1.0


def test_weighted_mean_and_ladder(spark):
    r = spark.createDataFrame([(4.0, None), (None, None), (4.0, 8.0)], "a double, b double").select(nm.weighted_mean_present([("a", 3), ("b", 1)]), nm.ladder("a", [(4, 10), (2, 5)], 1), nm.clamp("b", 0.0, 5.0)).collect()
    assert [tuple(x) for x in r] == [(4.0, 10.0, None), (None, None, None), (5.0, 10.0, 5.0)]


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 9.0), (2, "c", None), (2, "d", 1.0)], "k int, v string, s double")
    assert sorted(r.v for r in rel.first_by(df, ["k"], [F.col("s").desc_nulls_last()]).collect()) == ["b", "d"]
    ranks = {r.v: r.percentile for r in rel.percent_rank_of_values(df, "s").collect()}
    assert ranks == {"c": 0.0, "d": pytest.approx(1 / 3), "a": pytest.approx(2 / 3), "b": 1.0}
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 4, "x"), (1, 9, "y")], "k int, u int, v string")
    assert sorted((r.k, r.t, r.v) for r in rel.as_of_join(left, right, ["k"], "t", "u", ["v"]).collect()) == [(1, 5, "x"), (1, 10, "y"), (2, 1, None)]
    both = rel.upsert(df, spark.createDataFrame([(1, "new", 9.0)], df.schema), ["k"], "s")
    assert sorted(r.v for r in both.collect()) == ["d", "new"]
    assert rel.min_max(df, ["s"]).where("v = 'a'").first().s_scaled == pytest.approx(0.25)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6), (None, 1), (9, 8), (8, 7), (7, 9)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.where("a > 99")).count() == 0


def people(spark, rows):
    return m.with_keys(spark.createDataFrame(rows, "id string, name string, ein string, city string, zip string, state string"))


def test_match_cascade(spark):
    targets = people(spark, [("F1", "Acme Holdings", None, "LOS ANGELES", "90001", "CA"), ("F2", "Acme Logistics", "12", "SAN DIEGO", "92101", "CA"), ("F3", "Blue River Foods", None, "RENO", "89501", "NV"), ("F4", "Blue River Foods", None, "ELKO", "89801", "NV")])
    sources = people(spark, [("s1", "Totally Other", "12", None, None, "TX"), ("s2", "ACME HOLDINGS!", None, "LOS ANGELES", None, "CA"), ("s3", "Blue River Foods", None, None, None, "NV"), ("s4", "Blue River Foods", None, "ELKO", None, "NV"), ("s5", "BlueRiver Foods Inc", None, "ELKO", None, "NV"), ("s6", "None Such", None, None, None, "NV")])
    got = {r.id: (r.target_id, r.method, r.band, r.candidates) for r in m.match_cascade(sources, targets).collect()}
    assert got == {"s1": ("F2", "EIN_EXACT", "HIGH", 1), "s2": ("F1", "NAME_CITY_STATE_EXACT", "HIGH", 1), "s3": (None, "AMBIGUOUS_NAME_STATE_EXACT", "LOW", 2), "s4": ("F4", "NAME_CITY_STATE_EXACT", "HIGH", 1), "s5": ("F4", "COLLAPSED_SPACING_STATE_CITY_RESOLVED", "MEDIUM", 2)}


PAIR = "name_1 string, name_2 string, source_1 string, source_2 string, zip_1 string, zip_2 string, city_1 string, city_2 string, ein_1 string, ein_2 string, sim double"


@pytest.mark.parametrize("row,tier,rule", [
    (("Universal Dedicated Services", "UNIVERSAL DEDICATED", "a", "b", "1", "2", None, None, None, None, 0.6), "tier_D_different", None),
    (("Pension Master Trust Fund 1", "Pension Master Trust Fund 2", "a", "b", "12345", "12345", None, None, None, None, 0.9), "tier_series_demoted", "H4"),
    (("WILLIAMS JAMES K", "WILLIAMS JAMES P", "a", "b", "12345", "12345", None, None, None, None, 0.9), "tier_series_demoted", "person_name_block"),
    (("Acme Steel Works", "ACME STEEL-WORKS", "a", "b", "12345", "12345-1", "Reno", "RENO", None, None, 0.9), "tier_A_auto_merge", "H16"),
    (("Acme Steel", "Acme Steal", "a", "a", None, None, None, None, "9", "9", 0.6), "tier_A_auto_merge", "H13"),
    (("SF MARKETS, LLC", "SF MARKETS, LLC DBA SPROUTS FARMERS MARKET", "a", "a", "12345", "12345", None, None, None, None, 0.4), "tier_A_auto_merge", "H15"),
    (("Acme Steel Inc", "Acme Steel LLC", "a", "a", "12345", "12345", None, None, "1", "2", 0.4), "tier_C_review", "H2+H6_ein_veto"),
    ((None, "x", None, None, None, None, None, None, None, None, None), "tier_D_different", None),
])
def test_duplicate_rules(spark, row, tier, rule):
    got = m.classify_pairs(spark.createDataFrame([row], PAIR)).first()
    assert (got.tier, got.rule) == (tier, rule)


def test_blocks_votes_and_clusters(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "y", "p"), (4, None, "q")], "id long, a string, b string")
    got = {(r.a, r.b): r.methods for r in m.block_pairs(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {(1, 2): "a,b", (1, 3): "b", (2, 3): "b"}
    assert m.block_pairs(df, {"b": F.col("b")}, largest=2).count() == 0
    votes = spark.createDataFrame([(1, "dup", 3), (1, "dup", 3), (1, "diff", 1)], "k int, v string, w int")
    assert m.vote(votes, "k", "v", "w").first().confidence == "MEDIUM"
    won = m.merge_clusters(df.select("id"), spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), -F.col("id"))
    assert {r.id: (r.cluster, r.winner) for r in won.collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 4)}


def test_gower_and_raking(spark):
    one = spark.createDataFrame([(0.2, None, "311111", "311199"), (None, None, "1", "2")], "d double, e double, a string, b string")
    g = one.select(st.gower([(F.col("d"), F.col("d").isNotNull(), 2.0), (F.col("e"), F.col("e").isNotNull(), 1.0)]), st.code_distance("a", "b")).collect()
    assert [tuple(r) for r in g] == [(0.2, 0.2), (1.0, 1.0)]
    t = spark.createDataFrame([("r", "x", 1), ("r", "y", 3), ("s", "x", 2), ("s", "y", 2)], "a string, b string, n int")
    rows, cols = spark.createDataFrame([("r", 40.0), ("s", 60.0)], "a string, target double"), spark.createDataFrame([("x", 50.0), ("y", 50.0)], "b string, target double")
    out = st.raking(t, "n", "a", "b", rows, cols, 12)
    assert {r.a: pytest.approx(r.t, abs=0.01) for r in out.groupBy("a").agg(F.sum("value").alias("t")).collect()} == {"r": 40.0, "s": 60.0}


def test_gower_on_pairs_of_parts_is_that_of_columns(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.choice([None, r.random()]), r.choice([0.1, 0.5, None]), r.choice(["311111", "3111", "31", "42", "", None]), r.choice(["x", "y", None])) for i in range(120)] + [(500, "c", 0.1, 0.1, "1", "x"), (501, None, 0.1, 0.1, "1", "x")]
    df = spark.createDataFrame(rows, "id long, block string, u double, v double, code string, kind string")
    valid = lambda c: F.col(f"{c}_1").isNotNull() & F.col(f"{c}_2").isNotNull()
    parts = [*((F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")), valid(c), w) for c, w in (("u", 2.0), ("v", 1.5))), (st.code_distance("code_1", "code_2"), F.lit(True), 1.0), ((F.col("kind_1") != F.col("kind_2")).cast("double"), valid("kind"), 0.5)]
    want = sorted(map(tuple, st.nearest_in_blocks(df, "id", "block", F.floor(st.gower(parts) * 1e6 + 0.5) / 1e6, 4).collect()))
    features = [("u", "numeric", 2.0), ("v", "numeric", 1.5), ("code", "code", 1.0), ("kind", "exact", 0.5)]
    for part in (1000, 7):
        assert sorted(map(tuple, st.gower_nearest(df, "id", "block", features, 4, part).collect())) == want
    assert st.gower_nearest(df.limit(0), "id", "block", features).count() == 0


def test_nearest_in_large_blocks_are_those_of_all_rows(spark):
    n = 12_001
    rows = spark.range(n).selectExpr("id", "'hot' AS block", f"(id * 7919) % {n} AS x").unionByName(spark.createDataFrame([(n, "two", 0), (n + 1, "two", 0), (n + 2, None, 0)], "id long, block string, x long"))
    got = {(r.id, r.place): (r.other, r.distance) for r in st.nearest_in_blocks(rows, "id", "block", F.abs(F.col("x_1") - F.col("x_2")), 2).where("id < 300 or id >= 12001").collect()}
    owner = {i * 7919 % n: i for i in range(n)}
    for i in range(300):
        x = i * 7919 % n
        want = sorted((abs(y - x), owner[y]) for y in range(max(0, x - 3), min(n, x + 4)) if y != x)[:2]
        assert [got[i, 1], got[i, 2]] == [(o, d) for d, o in want]
    assert len(got) == 600
    pooled = st.nearest_in_blocks(rows.where("id < 50"), "id", "block", F.abs(F.col("x_1") - F.col("x_2")), 5, largest=3).collect()
    assert len({r.other for r in pooled}) == 3


def test_parents_stop_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), ("p", "q"), ("q", "r"), ("r", "p")], "child string, parent string")
    assert {r.child: (r.ancestor, r.steps) for r in st.ultimate_parents(e).collect()} == {"a": ("c", 2), "b": ("c", 1), "p": ("r", 2), "q": ("p", 2), "r": ("q", 2)}


def test_text_mining(spark):
    body = "Preamble\nARTICLE 1. Wages\nThe Employer shall pay $22.50 per hour.\nARTICLE 2: Leave\nWithin thirty (30) days the union may grieve.\nARTICLE 1\nshort"
    docs = spark.createDataFrame([(1, body), (2, None)], "id int, text string")
    got = tm.articles(docs, "id", "text").collect()
    assert [(r.number, r.title) for r in got] == [("1", "Wages"), ("2", "Leave")] and "22.50" in got[0].body
    v = docs.where("id = 1").select(tm.values("text").alias("v"), tm.modal_weight("text").alias("m")).first()
    assert v.v.dollars == ["22.50"] and v.v.days == ["30"] and v.v.periods == ["per hour"] and v.m == 0.9
    spans = readers.page_spans(["abc", "defg"])[1]
    p = spark.createDataFrame([(0, spans), (3, spans), (9, spans)], "at int, s array<struct<page:int,start:int,end:int>>").select(tm.page_of("at", "s")).collect()
    assert [r[0] for r in p] == [1, 2, None]
    over = spark.createDataFrame([(1, 0, 10, 0.9), (1, 4, 12, 0.8), (1, 9, 20, 0.7)], "k int, a int, b int, c double")
    assert sorted(r.a for r in tm.drop_overlaps(over, ["k"], "a", "b", "c").collect()) == [0, 9]
    page = spark.createDataFrame([("<p>a<script>x</p></script>&amp;<!-- c --> <b>b</b></p>",)], "h string").select(tm.html_text("h")).first()[0]
    assert page == "a & b"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,ZIP Code,Name\n"x, y",01234,z\n')
    assert readers.text_table(spark, str(tmp_path / "a.csv")).first().asDict() == {"name": "x, y", "zip_code": "01234", "name_2": "z"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.txt", "a|b\n1|2\n")
        z.writestr("two.txt", "a|b\n3|4\n")
    assert sorted(tuple(r) for r in readers.zipped_tables(spark, str(tmp_path / "z.zip"), ["a", "b"], "|").collect()) == [("one.txt", "1", "2"), ("two.txt", "3", "4")]
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("d.json", '{"k": 5}')
    assert readers.zipped_json(spark, str(tmp_path / "j.zip"), "k int").first().k == 5
    (tmp_path / "f.txt").write_text("AB00123\nCD     \n")
    assert [tuple(map(lambda x: x if x is None else str(x).rstrip("0"), r)) for r in readers.fixed_width(spark, str(tmp_path / "f.txt"), [("s", 1, 2, 0), ("n", 3, 5, 2)]).collect()] == [("AB", "1.23"), ("CD", None)]
    con = sqlite3.connect(tmp_path / "q.db")
    con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    con.execute("INSERT INTO t VALUES (1, 'x')")
    con.commit()
    con.close()
    assert tuple(readers.sqlite_rows(spark, str(tmp_path / "q.db"), "SELECT a, b FROM t", "a long, b string").first()) == (1, "x")
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3"><v>7</v></c><c r="C3"><v>8</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Code</t></si><si><t>Value</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert tuple(readers.workbook(spark, str(tmp_path / "w.xlsx"), ["code", "value"]).first()) == ("7", "8")
    rows = readers.html_tables(spark.createDataFrame([(1, "<table><tr><th>A</th><td><b>2</b></td></tr></table>")], "id int, h string"), "id", "h").first()
    assert rows.cells == ["A", "2"]
    assert readers.adapt(spark.createDataFrame([(1, "n")], "k int, nm string"), {"id": "k", "name": "nm"}).first().asDict()["ein"] is None


def test_snapshots_and_streams(spark, tmp_path):
    root = str(tmp_path / "snap")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    sinks.publish(first, root)
    with pytest.raises(ValueError):
        sinks.publish(first.where("k > 5"), root, guard=lambda df: (_ for _ in ()).throw(ValueError("empty")) if not df.count() else None)
    sinks.merge(spark.createDataFrame([(2, "c", 2), (3, "d", 1)], first.schema), root, ["k"], "t")
    assert sorted((r.k, r.v) for r in sinks.current(spark, root).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    data = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(data)
    base = spark.read.parquet(data)
    sinks.publish(base.limit(0), str(tmp_path / "ev"))
    q = delta.upsert_into(delta.once(delta.events(spark, data)), str(tmp_path / "ev"), ["event_id"], "ts", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sinks.current(spark, str(tmp_path / "ev")).count() == base.select("event_id").distinct().count()
    w = delta.windowed(delta.events(spark, data), "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == base.count()


def test_stems_follow_their_rules_in_order(spark):
    pairs = {"communications": "communicat", "production": "product", "industries": "industry", "directors": "direct", "center": "center", "manufacturing": "manufactur", "gas": "gas", "bees": "bee", "workers": "work", "boxes": "box"}
    got = spark.createDataFrame([(w,) for w in pairs], "w string").select("w", tx.stemmed("w").alias("s")).collect()
    assert {r.w: r.s for r in got} == pairs


def test_cascade_tiers(spark):
    """Cut-off and misspelled names, guards on short names, ties resolved by city."""
    kind = "id long, name string, ein string, city string, zip string, state string"
    targets = [(1, "Northern Lights Bakery", None, "a", None, "X"), (2, "Jonson Plumbing Supply", None, "a", None, "X"), (3, "Ab Cd", None, "a", None, "X"), (4, "Twin Rivers Mill", None, "a", None, "X"), (5, "Twin Rivers Mill", None, "b", None, "X")]
    sources = [(10, "Northern Lights Bak", None, None, None, "X"), (11, "Johnson Plumbing Supply", None, None, None, "X"), (12, "Cd Ab", None, None, None, "X"), (13, "Twin Rivers Mill", None, "b", None, "X"), (14, "Twin Rivers Mill", None, None, None, "X"), (15, "Mill Twin Rivers", None, "a", None, "X")]
    got = m.match_cascade(*(m.with_keys(spark.createDataFrame(x, kind)) for x in (sources, targets)))
    assert {r.id: (r.target_id, r.method) for r in got.collect()} == {10: (1, "TRUNCATED_NAME_STATE"), 11: (2, "PHONETIC_STATE"), 13: (5, "NAME_CITY_STATE_EXACT"), 14: (None, "AMBIGUOUS_NAME_STATE_EXACT"), 15: (4, "SORTED_TOKEN_STATE_CITY_RESOLVED")}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace as N

    conf = N(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        storage.shared_dir(N(sparkContext=N(getConf=lambda: conf, applicationId="a", master="spark://x"), conf=conf))


def test_quoted_line_ends_and_missing_headers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n"x\ny",1\n')
    assert readers.text_table(spark, str(tmp_path / "m.csv"), multiline=True).first().a == "x\ny"
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, str(tmp_path / "none"))
