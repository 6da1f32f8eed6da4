"""Entity-resolution queries. The public tables hold no noisy names, so both sides derive them from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions import similarity as sim
from plinthwork.functions import text as tx
from plinthwork.functions.numbers import rounded
from plinthwork.functions.storage import cut, table
from plinthwork.operators import matching as m
from plinthwork.operators import relational as rel
from plinthwork.plans.scorecards import R

FIRST = "acme;blue river;cedar;delta;eastern;ford hill;granite".split(";")
SECOND = "steel;logistics;foods;hosp;mfg;power;timber;textile;glass;mining;transp".split(";")
THIRD = "works;services;group;supply;intl;partners;systems;west;holdings;svcs;union;plant;yard".split(";")
TAILS = ["", ", Inc.", " LLC d/b/a Midtown Labs", " Corp", " & Co.", " Ltd"]


def _pick(words, k):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))


def _pick_sql(words, k):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][({k}) % {len(words)} + 1]"


def _name(k):
    return F.concat_ws(" ", _pick(FIRST, k), _pick(SECOND, k), _pick(THIRD, k))


def _name_sql(k):
    return f"({_pick_sql(FIRST, k)} || ' ' || {_pick_sql(SECOND, k)} || ' ' || {_pick_sql(THIRD, k)})"


# SQL of the normalisers
def std_sql(x):
    s = f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for tail in (r"\bd\s*b\s*a\b.*$", r"\bdoing business as\b.*$", r"\ba\s*k\s*a\b.*$"):
        s = f"trim(regexp_replace({s}, '{tail}', '', 'g'))"
    return s


def _words_sql(x):
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def agg_sql(x):
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in tx.ABBREVIATIONS.items())
    drop = ", ".join(f"'{w}'" for w in [*tx.LEGAL, *tx.NOISE])
    return f"array_to_string(list_filter(list_transform({_words_sql(std_sql(x))}, lambda t: coalesce(MAP {{{pairs}}}[t], t)), lambda u: u NOT IN ({drop})), ' ')"


def fuzzy_sql(x):
    return f"array_to_string(list_sort(list_distinct(list_filter({_words_sql(agg_sql(x))}, lambda t: length(t) > 1))), ' ')"


def _noisy(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.when(k % 3 == 0, F.upper(_name(k))).otherwise(F.initcap(_name(k))), _pick(TAILS, k)).alias("name"))


NOISY = f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper({_name_sql('c_custkey')}) ELSE {_name_sql('c_custkey')} END || {_pick_sql(TAILS, 'c_custkey')} AS name FROM customer"


def name_normalize_std(spark, d):
    return _noisy(spark, d).select("c_custkey", tx.standard_name("name").alias("normal"))


def name_normalize_agg(spark, d):
    return _noisy(spark, d).select("c_custkey", tx.aggressive_name("name").alias("normal"))


def name_normalize_fuzzy(spark, d):
    return _noisy(spark, d).select("c_custkey", tx.fuzzy_name("name").alias("normal"), tx.collapsed(tx.aggressive_name("name")).alias("collapsed"))


def _names(spark, d):
    return table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()


def _name_pairs(spark, d):
    """Pairs of part names with the same last word, each once."""
    n = _names(spark, d).withColumn("key", F.substring_index("name", " ", -1))
    return n.withColumnRenamed("name", "a").join(n.withColumnRenamed("name", "b"), "key").where("a < b").select("a", "b")


PAIRS = "n AS (SELECT DISTINCT lower(p_name) AS name, string_split(lower(p_name), ' ')[-1] k FROM part), p AS (SELECT x.name a, y.name b FROM n x JOIN n y ON x.k = y.k AND x.name < y.name)"
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def trigram_similarity_topk(spark, d):
    """Three nearest names by trigram similarity among those sharing a block."""
    p = _name_pairs(spark, d)
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("similarity", rounded(sim.trigram_similarity("a", "b")))
    return rel.top_k_by(both.where("similarity >= 0.3"), ["a"], [F.desc("similarity"), F.asc("b")], 3, "place").withColumn("place", F.col("place").cast("long"))


_GA, _GB = GRAMS.format(x="a"), GRAMS.format(x="b")
TRIGRAM = f"""WITH {PAIRS}, q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), g AS (SELECT a, b, {_GA} x, {_GB} y FROM q),
s AS (SELECT a, b, {R("len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y)))")} similarity FROM g)
SELECT a, b, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) place FROM s WHERE similarity >= 0.3) WHERE place <= 3"""


def jaro_winkler_pairs(spark, d):
    p = _name_pairs(spark, d)
    return p.select("a", "b", rounded(sim.jaro_winkler_col("a", "b")).alias("jaro_winkler"), F.levenshtein("a", "b").cast("long").alias("edits"))


def bigram_jaccard(spark, d):
    return _name_pairs(spark, d).select("a", "b", rounded(sim.bigram_jaccard("a", "b")).alias("jaccard"), rounded(sim.token_overlap("a", "b")).alias("overlap"))


BIGRAM = f"""WITH {PAIRS}, g AS (SELECT a, b, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) y, list_distinct(string_split(a, ' ')) u, list_distinct(string_split(b, ' ')) v FROM p)
SELECT a, b, {R("len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y)))")} jaccard, {R("len(list_intersect(u, v))::DOUBLE / least(len(u), len(v))")} overlap FROM g"""


def indel_token_ratios(spark, d):
    p = _name_pairs(spark, d)
    return p.select("a", "b", rounded(sim.indel_col("a", "b")).alias("ratio"), rounded(sim.token_sort_col("a", "b")).alias("token_sort"), rounded(sim.token_set_col("a", "b")).alias("token_set"), rounded(sim.composite_col("a", "b")).alias("composite"))


def sequence_matcher(spark, d):
    return _name_pairs(spark, d).select("a", "b", rounded(sim.sequence_col("a", "b")).alias("ratio"))


def phonetic_keys(spark, d):
    return _names(spark, d).select("name", sim.phonetic_key("name").alias("key"), F.soundex(F.substring_index("name", " ", 1)).alias("soundex"))


def _targets(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(k.alias("id"), _name(k).alias("name"), F.when(k % 10 == 0, F.concat(F.lit("E"), k.cast("string"))).alias("ein"), F.concat(F.lit("city"), (k % 4).cast("string")).alias("city"), F.lpad((k % 900).cast("string"), 5, "1").alias("zip"), F.col("n_name").alias("state"), F.concat((k % 7 + 30).cast("string"), F.lit("11")).alias("naics"))


TARGETS = f"t AS (SELECT c_custkey id, {_name_sql('c_custkey')} AS name, CASE WHEN c_custkey % 10 = 0 THEN 'E' || c_custkey END ein, 'city' || (c_custkey % 4) city, lpad((c_custkey % 900)::VARCHAR, 5, '1') zip, n_name state, (c_custkey % 7 + 30) || '11' naics FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _sources(spark, d):
    """Suppliers as noisy records of the customers with their keys."""
    s, t = table(spark, d, "supplier"), _targets(spark, d)
    k, name = F.col("s_suppkey"), F.col("name")
    noisy = F.when(k % 6 == 0, F.upper(name)).when(k % 6 == 1, F.concat(name, F.lit(", Inc."))).when(k % 6 == 2, F.regexp_replace(name, " ", "")).when(k % 6 == 3, F.concat_ws(" ", F.substring_index(name, " ", -1), F.regexp_replace(name, r" \S+$", ""))).when(k % 6 == 4, F.concat(F.lit("12 "), name)).otherwise(F.concat(name, F.lit(" xyz")))
    return s.join(t, s["s_suppkey"] == t["id"]).select(k.alias("id"), noisy.alias("name"), F.when(k % 20 == 0, F.col("ein")).alias("ein"), F.when(k % 5 != 0, F.col("city")).alias("city"), F.when(k % 7 != 0, F.col("zip")).alias("zip"), "state", "naics")


SOURCES = r"""s AS (SELECT s_suppkey id, CASE s_suppkey % 6 WHEN 0 THEN upper(name) WHEN 1 THEN name || ', Inc.' WHEN 2 THEN replace(name, ' ', '') WHEN 3 THEN string_split(name, ' ')[-1] || ' ' || regexp_replace(name, ' \S+$', '') WHEN 4 THEN '12 ' || name ELSE name || ' xyz' END AS name, CASE WHEN s_suppkey % 20 = 0 THEN ein END ein, CASE WHEN s_suppkey % 5 <> 0 THEN city END city, CASE WHEN s_suppkey % 7 <> 0 THEN zip END zip, state, naics FROM supplier JOIN t ON s_suppkey = t.id)"""


def match_cascade(spark, d):
    """The cascade's exact and derived-key tiers."""
    tiers = [t for t in m.TIERS if t[0] != "PHONETIC_STATE"]
    out = m.match_cascade(m.with_keys(_sources(spark, d)), m.with_keys(_targets(spark, d)), tiers)
    return out.select("id", "target_id", "method", F.col("rank").cast("long").alias("rank"), "score", "candidates", "band", "status")


# Written out here, not taken from the operator's tables: a wrong value there must show.
STEM_CASES = [("ations", 6, "at"), ("ation", 5, "at"), ("tions", 5, "t"), ("tion", 4, "t"), ("ments", 5, ""), ("ment", 4, ""), ("ings", 4, ""), ("ing", 3, ""), ("ies", 3, "y"), ("ers", 3, ""), ("ors", 3, ""), ("es", 2, ""), ("s", 1, "")]


def _stem_sql(x):
    cases = " ".join(f"WHEN suffix(t, '{e}') AND length(t) - {n} + {len(p)} >= 3 THEN substr(t, 1, length(t) - {n}) || '{p}'" for e, n, p in STEM_CASES)
    return f"array_to_string(list_transform({_words_sql(x)}, lambda t: CASE WHEN length(t) <= 3 THEN t {cases} ELSE t END), ' ')"


def name_stems(spark, d):
    """Stems of the words of part names and of words that each rule meets."""
    words = "communications production industries directors center manufacturing equipments fundings workers boxes gas ations bees".split()
    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    return names.unionByName(names.select(F.concat_ws(" ", F.col("name"), *[F.lit(w) for w in words]).alias("name"))).select("name", tx.stemmed("name").alias("stems"))


STEMMED = f"WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), m AS (SELECT name FROM n UNION ALL SELECT name || ' communications production industries directors center manufacturing equipments fundings workers boxes gas ations bees' FROM n) SELECT name, {_stem_sql('name')} stems FROM m"


def _keys_sql(x):
    return f"""(SELECT *, nullif(n1, '') std, nullif(n2, '') agg, array_to_string(list_sort({_words_sql('n2')}), ' ') srt, replace(n2, ' ', '') col, CASE WHEN bare <> trim(name) AND length(bare) >= 3 THEN nullif({agg_sql('bare')}, '') END strip, {_stem_sql('n2')} stem FROM (SELECT *, {std_sql('name')} n1, {agg_sql('name')} n2, regexp_replace(trim(name), '^\\d+\\s+', '') bare FROM {x}))"""


def _tier_sql(tier, rank, score, on):
    near = "0" if tier == "NAME_CITY_STATE_EXACT" else "count(*) FILTER (t.city = s.city)"
    return f"SELECT s.id, '{tier}' tier, {rank} AS rank, {score}::DOUBLE base, count(*) candidates, min(t.id) only_id, {near} near, min(t.id) FILTER (t.city = s.city) near_id FROM sk s JOIN tk t ON {on} GROUP BY s.id"


_ST, _SIX = "s.state = t.state", "length(s.agg) >= 6"
CASCADE_TIERS = (
    ("EIN_EXACT", 100, 1.00, "s.ein = t.ein"), ("NAME_CITY_STATE_EXACT", 90, 0.95, f"s.std = t.std AND s.city = t.city AND {_ST}"), ("NAME_ZIP_STATE", 85, 0.93, f"s.std = t.std AND s.zip = t.zip AND {_ST}"),
    ("NAME_STATE_EXACT", 80, 0.90, f"s.std = t.std AND {_ST}"), ("NAME_AGGRESSIVE_STATE", 60, 0.75, f"{_SIX} AND s.agg = t.agg AND {_ST}"), ("SORTED_TOKEN_STATE", 57, 0.85, f"{_SIX} AND s.srt <> s.agg AND s.srt = t.srt AND {_ST}"),
    ("COLLAPSED_SPACING_STATE", 55, 0.82, f"{_SIX} AND contains(s.agg, ' ') AND s.col = t.col AND t.agg IS NOT NULL AND {_ST}"),
    ("TRUNCATED_NAME_STATE", 54, 0.80, f"{_ST} AND s.agg <> t.agg AND ((length(s.agg) >= 10 AND prefix(t.agg, s.agg)) OR (length(t.agg) >= 10 AND prefix(s.agg, t.agg)))"),
    ("STRIPPED_LEADING_NUMS_STATE", 53, 0.80, f"s.strip = t.agg AND {_ST}"), ("STEMMED_NAME_STATE", 52, 0.78, f"{_SIX} AND s.stem <> s.agg AND s.stem = t.stem AND t.agg IS NOT NULL AND {_ST}"),
)
CASCADE = f"""WITH {TARGETS}, {SOURCES}, sk AS (FROM {_keys_sql('s')}), tk AS (FROM {_keys_sql('t')}),
h AS ({" UNION ALL ".join(_tier_sql(*t) for t in CASCADE_TIERS)}), b AS (SELECT DISTINCT ON (id) *, candidates = 1 one, candidates > 1 AND near = 1 AS city FROM h ORDER BY id, rank DESC),
r AS (SELECT id, CASE WHEN one THEN only_id WHEN city THEN near_id END target_id, CASE WHEN one THEN tier WHEN city THEN tier || '_CITY_RESOLVED' ELSE 'AMBIGUOUS_' || tier END "method", rank::BIGINT AS rank, CASE WHEN one OR city THEN base ELSE 0 END::DOUBLE score, candidates FROM b)
SELECT *, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END band, CASE WHEN score >= 0.70 THEN 'active' ELSE 'rejected' END status FROM r"""


def match_phonetic(spark, d):
    """The cascade with all tiers, the phonetic one included, which SQL cannot express."""
    return m.match_cascade(m.with_keys(_sources(spark, d)), m.with_keys(_targets(spark, d))).select("id", "target_id", "method", F.col("rank").cast("long").alias("rank"), "score", "candidates")


def _blocks():
    return {"state_first3": F.concat(F.col("state"), F.lit("|"), F.substring("name", 1, 3), (F.col("id") % 11).cast("string")), "zip": F.col("zip"), "naics_city": F.concat("naics", F.lit("|"), F.col("city"), F.lit("|"), "state")}


def blocking_pairs(spark, d):
    return m.block_pairs(_targets(spark, d), _blocks(), 100)


BLOCKED = f"""{TARGETS}, k AS (SELECT id, 'state_first3' m, state || '|' || substr(name, 1, 3) || (id % 11) k FROM t UNION SELECT id, 'zip', zip FROM t UNION SELECT id, 'naics_city', naics || '|' || city || '|' || state FROM t), f AS (SELECT m, k FROM k GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 100), e AS (SELECT k.* FROM k SEMI JOIN f USING (m, k)), bp AS (SELECT x.id a, y.id b, string_agg(DISTINCT x.m, ',' ORDER BY x.m) methods FROM e x JOIN e y ON x.m = y.m AND x.k = y.k AND x.id < y.id GROUP BY 1, 2)"""


def pair_features(spark, d):
    """Features of blocked pairs, their weighted score and its triage; keys and grams are made once a record."""
    t = _targets(spark, d)
    grams = {"standard": sim.trigrams(tx.standard_name("name")), "aggressive": sim.trigrams(tx.aggressive_name("name")), "sorted": sim.trigrams(tx.fuzzy_name("name")), "bigrams": sim.bigrams("name"), "words": F.array_distinct(tx.tokens("name"))}
    records = cut(t.select(*[c for c in t.columns if c != "name"], *[v.alias(k) for k, v in grams.items()]), "records")
    sides = [records.select(*[F.col(c).alias(f"{c}_{i}") for c in records.columns]) for i in (1, 2)]
    j = m.block_pairs(t, _blocks(), 100).join(sides[0], F.col("a") == F.col("id_1")).join(sides[1], F.col("b") == F.col("id_2"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False)).cast("double")
    f = {k: sim.jaccard(f"{k}_1", f"{k}_2") for k in ("standard", "aggressive", "sorted", "bigrams")} | {
        "ein": same(F.col("ein_1"), F.col("ein_2")), "zip": same(F.substring("zip_1", 1, 5), F.substring("zip_2", 1, 5)), "city": same(F.col("city_1"), F.col("city_2")), "naics": same(F.substring("naics_1", 1, 2), F.substring("naics_2", 1, 2)),
        "overlap": sim.overlap("words_1", "words_2"), "ein_conflict": F.coalesce(F.col("ein_1") != F.col("ein_2"), F.lit(False)),
    }
    j = j.select("a", "b", *[c for c in j.columns if c.startswith(("city_", "zip_", "naics_"))], *[v.alias(k) for k, v in f.items()])
    score = rounded(m.pair_score({k: F.col(k) for k in f}))
    return j.select("a", "b", rounded("standard").alias("standard"), rounded("bigrams").alias("bigrams"), score.alias("score"), m.corroboration(j).alias("corroboration")).withColumn("triage", F.when(F.col("score") >= 0.6, "auto_dup").when(F.col("score") < 0.2, "auto_diff").otherwise("ambiguous"))


def _jac_sql(x, y):
    return f"coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(len({x}) + len({y}) - len(list_intersect({x}, {y})), 0), 0)"


def _g(x):
    return GRAMS.format(x=x)


FEATURES = f"""WITH {BLOCKED}, n AS (SELECT *, {_g('n1')} g1, {_g('n2')} g2, {_g('n3')} g3, list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) bg, list_distinct(string_split(name, ' ')) ws FROM (SELECT *, {std_sql('name')} n1, {agg_sql('name')} n2, {fuzzy_sql('name')} n3 FROM t)),
ff AS (SELECT a, b, {_jac_sql('x.g1', 'y.g1')} standard, {_jac_sql('x.g2', 'y.g2')} aggressive, {_jac_sql('x.g3', 'y.g3')} sorted, {_jac_sql('x.bg', 'y.bg')} bigrams, coalesce(x.ein = y.ein, false)::INT::DOUBLE ein, (x.zip = y.zip)::INT::DOUBLE zip, (x.city = y.city)::INT::DOUBLE city, (left(x.naics, 2) = left(y.naics, 2))::INT::DOUBLE naics, len(list_intersect(x.ws, y.ws))::DOUBLE / least(len(x.ws), len(y.ws)) overlap, coalesce(x.ein <> y.ein, false) conflict FROM bp JOIN n x ON a = x.id JOIN n y ON b = y.id),
s AS (SELECT *, standard * 0.20::DOUBLE + aggressive * 0.15::DOUBLE + sorted * 0.10::DOUBLE + bigrams * 0.05::DOUBLE + ein * 0.25::DOUBLE + zip * 0.10::DOUBLE + city * 0.05::DOUBLE + naics * 0.05::DOUBLE + overlap * 0.05::DOUBLE total FROM ff), r AS (SELECT *, {R("CASE WHEN conflict THEN total * 0.5::DOUBLE ELSE total END")} score FROM s)
SELECT a, b, {R("standard")} standard, {R("bigrams")} bigrams, score, (city::INT * 2 + zip::INT * 3 + naics::INT * 2)::BIGINT corroboration, CASE WHEN score >= 0.6 THEN 'auto_dup' WHEN score < 0.2 THEN 'auto_diff' ELSE 'ambiguous' END triage FROM r"""


def rule_tiers(spark, d):
    """The duplicate rules over supplier records and all customers that share a ZIP or an industry and city with them."""
    s, t = _sources(spark, d), _targets(spark, d)
    a, b = (x.select(*[F.col(c).alias(f"{c}_{i}") for c in x.columns]) for i, x in ((1, s), (2, t)))
    keys = [(F.col("zip_1"), F.col("zip_2")), (F.concat_ws("|", "naics_1", "city_1", "state_1"), F.concat_ws("|", "naics_2", "city_2", "state_2"))]
    met = [a.withColumn("key", x).join(b.withColumn("key", y), "key").drop("key") for x, y in keys]
    p = met[0].unionByName(met[1]).distinct().withColumn("source_1", F.lit("supplier")).withColumn("source_2", F.lit("customer"))
    sims = F.greatest(sim.trigram_similarity(tx.standard_name("name_1"), tx.standard_name("name_2")), sim.trigram_similarity(tx.aggressive_name("name_1"), tx.aggressive_name("name_2")))
    return m.classify_pairs(p.withColumn("sim", sims)).select("id_1", "id_2", "name_1", "name_2", "tier", "rule")


def dedup_components(spark, d):
    """Documents of one normalised text or one long first line, as clusters with a winner each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("whole"), F.sha2(F.concat("source", F.substring_index("text", "\n", 1)), 256).alias("start"))
    stars = [docs.groupBy(k).agg(F.min("id").alias("b")).join(docs.select(F.col("id").alias("a"), k), k).where("a <> b").select("a", "b") for k in ("whole", "start")]
    return m.merge_clusters(docs.select("id"), stars[0].unionByName(stars[1]), F.col("id") % 3).select("id", "cluster", "winner")


COMPONENTS = r"""WITH RECURSIVE d AS (SELECT doc_id id, sha256(text) w, sha256(source || string_split(text, chr(10))[1]) s FROM documents), e AS (SELECT x.id a, y.id b FROM d x JOIN d y ON (x.w = y.w OR x.s = y.s) AND x.id <> y.id), c AS (SELECT id AS node, id AS reach FROM d UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a), g AS (SELECT node AS id, min(reach) AS cluster FROM c GROUP BY 1)
SELECT id, cluster, first_value(id) OVER (PARTITION BY cluster ORDER BY id % 3, id) AS winner FROM g"""


def canonical_groups(spark, d):
    """Groups by aggressive name: across states only if one segment covers them; a representative and size each."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    base = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(k.alias("id"), tx.aggressive_name(_name(k % 60)).alias("key"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("affiliation"), F.col("c_acctbal").cast("decimal(18,2)").alias("size"))
    per = base.groupBy("key").agg(F.count_distinct("state").alias("states"), F.count_distinct("affiliation").alias("affiliations"))
    placed = base.join(per, "key").withColumn("place", F.when((F.col("states") >= 2) & (F.col("affiliations") == 1), F.lit("*")).otherwise(F.col("state")))
    largest = placed.groupBy("key", "place", "affiliation").agg(F.max("size").alias("m"))
    total = largest.groupBy("key", "place").agg(F.sum("m").cast("double").alias("workers"))
    head = rel.first_by(placed, ["key", "place"], [F.desc("size"), F.asc("id")]).select("key", "place", F.col("id").alias("representative"))
    size = placed.groupBy("key", "place").agg(F.count(F.lit(1)).alias("members"))
    return size.join(total, ["key", "place"]).join(head, ["key", "place"])


GROUPS = f"""WITH b AS (SELECT c_custkey id, {agg_sql(_name_sql('(c_custkey % 60)'))} key, n_name state, c_mktsegment aff, c_acctbal::DECIMAL(18,2) size FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT key, count(DISTINCT state) s, count(DISTINCT aff) a FROM b GROUP BY 1), q AS (SELECT b.*, CASE WHEN s >= 2 AND a = 1 THEN '*' ELSE state END place FROM b JOIN p USING (key)),
w AS (SELECT key, place, sum(m)::DOUBLE workers FROM (SELECT key, place, aff, max(size) m FROM q GROUP BY 1, 2, 3) GROUP BY 1, 2), h AS (SELECT DISTINCT ON (key, place) key, place, id representative FROM q ORDER BY key, place, size DESC, id)
SELECT key, place, count(*) members, any_value(workers) workers, any_value(representative) representative FROM q JOIN w USING (key, place) JOIN h USING (key, place) GROUP BY 1, 2"""


def fuzzy_match(spark, d):
    """Trigram candidates within a state, then the composite score at its floor of 0.90."""
    s, t = _sources(spark, d).withColumn("key", tx.aggressive_name("name")), _targets(spark, d).withColumn("key", tx.aggressive_name("name"))
    c = m.fuzzy_candidates(s, t, "state", "key", 20)
    j = c.join(s.select("id", F.col("key").alias("x")), "id").join(t.select(F.col("id").alias("other"), F.col("key").alias("y")), "other").withColumn("score", rounded(sim.composite_col("x", "y")))
    return rel.first_by(j.where("score >= 0.90"), ["id"], [F.desc("score"), F.asc("other")]).select("id", "other", "score", F.col("shared").cast("long").alias("shared"))


def ensemble_vote(spark, d):
    """Verdicts of several methods on an order, weighed to one."""
    o = table(spark, d, "orders")
    parts = [o.select("o_custkey", F.col("o_orderstatus").alias("verdict"), F.lit(2).alias("weight")), o.select("o_custkey", F.when(F.col("o_totalprice") > 200000, "F").otherwise("O").alias("verdict"), F.lit(1).alias("weight"))]
    return m.vote(parts[0].unionByName(parts[1]), "o_custkey", "verdict", "weight").select("o_custkey", "verdict", "w", "n", rounded("share").alias("share"), rounded("unanimity").alias("unanimity"), "confidence")


VOTE = f"""WITH v AS (SELECT o_custkey, o_orderstatus verdict, 2 w FROM orders UNION ALL SELECT o_custkey, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END, 1 FROM orders), g AS (SELECT o_custkey, verdict, sum(w)::BIGINT w, count(*) n FROM v GROUP BY 1, 2), s AS (SELECT *, w::DOUBLE / (sum(w) OVER (PARTITION BY o_custkey))::DOUBLE share, n::DOUBLE / (sum(n) OVER (PARTITION BY o_custkey))::DOUBLE u FROM g), b AS (SELECT DISTINCT ON (o_custkey) * FROM s ORDER BY o_custkey, w DESC, verdict)
SELECT o_custkey, verdict, w, n, {R("share")} share, {R("u")} unanimity, CASE WHEN u >= 0.8 AND share >= 0.7 THEN 'HIGH' WHEN u >= 0.6 OR share >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END confidence FROM b"""

SQL = {
    "name_normalize_std": f"WITH n AS ({NOISY}) SELECT c_custkey, {std_sql('name')} normal FROM n",
    "name_normalize_agg": f"WITH n AS ({NOISY}) SELECT c_custkey, {agg_sql('name')} normal FROM n",
    "name_normalize_fuzzy": f"WITH n AS ({NOISY}) SELECT c_custkey, {fuzzy_sql('name')} normal, replace({agg_sql('name')}, ' ', '') AS \"collapsed\" FROM n",
    "trigram_similarity_topk": TRIGRAM,
    "jaro_winkler_pairs": f"WITH {PAIRS} SELECT a, b, {R('jaro_winkler_similarity(a, b)')} jaro_winkler, levenshtein(a, b) edits FROM p",
    "bigram_jaccard": BIGRAM,
    "match_cascade": CASCADE,
    "name_stems": STEMMED,
    "blocking_pairs": f"WITH {BLOCKED} FROM bp",
    "pair_features": FEATURES,
    "dedup_components": COMPONENTS,
    "canonical_groups": GROUPS,
    "ensemble_vote": VOTE,
}
ROWS_ONLY = (match_phonetic, indel_token_ratios, sequence_matcher, phonetic_keys, rule_tiers, fuzzy_match)
QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in ROWS_ONLY}
