"""Divergence of sources within a language, and the terms in which a source stands out, in exact integers.

Terms are counted once: tasks tally what they read, tallies meet by language and term, and the same partitions give
the number of documents with a term, so that one shuffle finds both the counts and the kept terms.

A source's smoothed distribution equals its baseline (the value of a count of zero) at every term that it lacks. So
the distance of two sources is V times the distance of their baselines, plus a correction for each term that either
has: one side's corrections follow from how often each count occurs in the source (sums over sorted values, one
binary search a partner), and only terms that both have meet as pairs, in blocks of terms and tiles of sources.

The largest values of each source are found by radix select: histograms of ten bits at a time, from the highest,
narrow each source's k-th value down; ties at that value are narrowed by ever longer prefixes of their UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut, drop

SCALE, PRIOR, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Sources of a tile, and rows of a block of terms (as many as a tile has pairs, so a block gives out no more than it takes in).
TILE = 128
BLOCK = TILE * TILE
#: Entries that a task tallies before it passes them on.
TALLY = 1 << 20
_DIGIT = 10
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _tally(batches):
    """lang, source, term, occurrences and documents, summed over what the task has read."""
    counts: dict = {}
    held = 0

    def out():
        for (lang, source), (n, df) in counts.items():
            if n:
                terms = pa.array(list(n), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "df"],
                )

    for batch in batches:
        for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = body.as_py().translate(_TERMS).split()
            n, df = counts.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            once = set(words)
            df.update(once)
            held += len(once) + 1
            if held > 2 * TALLY:
                held = sum(len(x) + 1 for x, _ in counts.values())
                if held > TALLY:
                    yield from out()
                    counts, held = {}, 0
    yield from out()


def _share(n, total, v) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)), exact; null without kept terms."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10, 0)) * cast({n} + {PRIOR} as decimal(20, 0))) div nullif(cast({total} + {PRIOR} * {v} as decimal(20, 0)), 0)")


def term_shares(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, x, v, base) and their kept terms (lang, source, x, base, term, n, p, q), both written.

    ``x`` numbers the sources of a language, ``v`` counts its kept terms, ``base`` is the share of an absent
    term; p is the term's share in the group and q in the language. Only terms that occur in the group are listed.
    """
    given = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    tallied = given.mapInArrow(_tally, "lang string, source string, term binary, n bigint, df bigint")
    met = tallied.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))  # no further shuffle
    term = Window.partitionBy("lang", "term")
    spread = met.withColumns({"docs": F.sum("df").over(term), "ln": F.sum("n").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("long")})
    kept = cut(spread.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "ln", "first"), "kept-terms")

    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("ltotal"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = given.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    numbered = named.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "ltotal")), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("x"))
    groups = cut(numbered.withColumn("base", _share("0", "total", "v")), "sources")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "x", "base", "term", "n", _share("n", "total", "v").alias("p"), _share("ln", "ltotal", "v").alias("q"))
    return groups, shares


def largest(rows: DataFrame, group: tuple[str, ...], value: str, item: str, k: int = TOP, bits: int = 30) -> DataFrame:
    """The k rows of each group with the largest values, ties by the bytes of ``item`` (binary) ascending; all of smaller groups.

    Values are positive and below 2 ** bits, items of a group are distinct. ``rows`` should be written: it is read
    once for each digit, and each pass shuffles histogram counts only.
    """
    by, at = list(group), Window.partitionBy(*group)
    state, shift = None, bits
    while shift > 0:
        shift -= _DIGIT
        pool, left = rows, F.lit(k).cast("long")
        if state is not None:
            pool, left = rows.join(state, by).where(F.shiftright(value, shift + _DIGIT) == F.col("high")), F.col("left")
        bins = pool.withColumns({"high": F.shiftright(value, shift), "left": left}).groupBy(*by, "high", "left").agg(F.count(F.lit(1)).alias("n"))
        down = bins.withColumn("upto", F.sum("n").over(at.orderBy(F.desc("high"))))
        was = state
        state = cut(down.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left"))).select(*by, "high", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n"), "digits")
        if was is not None:
            drop(was)

    # Now high is the k-th value, and ``left`` of its n rows are wanted: those up to a prefix of their bytes.
    last, width = state, 0
    state = state.withColumns({"upto": F.lit(None).cast("binary"), "width": F.lit(0)})
    while True:
        settled, kept = Observation(), last
        state = last = cut(state, "ties", (settled, F.sum((F.col("n") > F.col("left")).cast("long")).alias("open")))
        drop(kept)
        if not settled.get["open"]:
            break
        width, was = 2 * width or 8, width
        open_ = state.where("n > left").select(*by, "high", "left", F.col("upto").alias("was"))
        pool = rows.join(open_, by).where(F.col(value) == F.col("high"))
        if was:
            pool = pool.where(F.expr(f"substring(`{item}`, 1, {was})") == F.col("was"))
        bins = pool.withColumn("upto", F.expr(f"substring(`{item}`, 1, {width})")).groupBy(*by, "high", "left", "upto").agg(F.count(F.lit(1)).alias("n"))
        up = bins.withColumn("sum", F.sum("n").over(at.orderBy("upto")))
        narrowed = up.where((F.col("sum") >= F.col("left")) & (F.col("sum") - F.col("n") < F.col("left"))).select(*by, "high", (F.col("left") - F.col("sum") + F.col("n")).alias("left"), "n", "upto", F.lit(width).alias("width"))
        state = state.where("n <= left").unionByName(narrowed)
    limits = state.select(*by, F.col("high").alias("__kth"), F.col("upto").alias("__upto"), F.col("width").alias("__width"))
    tied = F.col("__upto").isNull() | (F.expr(f"substring(`{item}`, 1, __width)") <= F.col("__upto"))
    wanted = rows.join(limits, by, "left").where(F.col("__kth").isNull() | (F.col(value) > F.col("__kth")) | (F.col(value) == F.col("__kth")) & tied)
    return wanted.drop("__kth", "__upto", "__width")


def _one_sided(batches):
    """For a source and each partner of a tile: corrections for the source's own terms, and once a pair the baselines' part."""
    for batch in batches:
        for lang, x, v, base, levels, tile in zip(*(batch.column(c).to_pylist() for c in range(6))):
            y = np.array([t["x"] for t in tile], np.int64)
            far = np.array([t["base"] or 0 for t in tile], np.int64)
            base, p, m = base or 0, np.array([t["p"] for t in levels], np.int64), np.array([t["m"] for t in levels], np.int64)
            order = np.argsort(p)
            p, m = p[order], m[order]
            below = np.searchsorted(p, far)
            terms, sums = np.concatenate(([0], np.cumsum(m))), np.concatenate(([0], np.cumsum(m * p)))
            apart = sums[-1] - 2 * sums[below] + far * (2 * terms[below] - terms[-1]) - terms[-1] * np.abs(base - far)
            apart += np.where(x < y, v * np.abs(base - far), 0)
            other = y != x
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * int(other.sum()), pa.string()), pa.array(np.minimum(x, y)[other]), pa.array(np.maximum(x, y)[other]), pa.array(apart[other])], ["lang", "lo", "hi", "f"]
            )


def _both_sided(key, rows):
    """Corrections for the terms that two sources share, summed over a block of terms and a pair of tiles."""
    lang, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
    term = pc.dictionary_encode(rows["term"].combine_chunks()).indices.to_numpy(zero_copy_only=False)
    x, p, base = (rows[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "p", "base"))
    order = np.lexsort((x, term))
    term, x, p, base = term[order], x[order], p[order], base[order]
    sums = np.zeros((TILE, TILE), np.int64)
    for d in range(1, len(term)):
        at = np.flatnonzero(term[d:] == term[:-d])
        if not len(at):
            break
        if left != right:
            at = at[(x[at] // TILE == left) & (x[at + d] // TILE == right)]
        a, b = at, at + d
        f = np.abs(p[a] - p[b]) - np.abs(p[a] - base[b]) - np.abs(base[a] - p[b]) + np.abs(base[a] - base[b])
        np.add.at(sums, (x[a] - left * TILE, x[b] - right * TILE), f)
    lo, hi = np.nonzero(sums)
    return pa.table({"lang": pa.array([lang] * len(lo), pa.string()), "lo": lo + left * TILE, "hi": hi + right * TILE, "f": sums[lo, hi]})


def source_pairs(groups: DataFrame, shares: DataFrame, blocks: int) -> DataFrame:
    """``lang, lo, hi, f``: the distance of each two sources of a language, numbered as in ``groups``."""
    levels = shares.groupBy("lang", "x", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "x").agg(F.collect_list(F.struct("p", "m")).alias("levels"))
    tiles = groups.groupBy("lang", F.floor(F.col("x") / TILE).alias("j")).agg(F.collect_list(F.struct("x", "base")).alias("tile"))
    own = groups.join(levels, ["lang", "x"], "left").select("lang", F.col("x").cast("long"), "v", "base", F.coalesce("levels", F.array().cast("array<struct<p: bigint, m: bigint>>")).alias("levels"))
    single = own.join(tiles, "lang").select("lang", "x", "v", "base", "levels", "tile").mapInArrow(_one_sided, "lang string, lo bigint, hi bigint, f bigint")

    last = groups.groupBy("lang").agg(F.floor(F.max("x") / TILE).alias("last"))
    mine = F.floor(F.col("x") / TILE)
    dealt = shares.join(last, "lang").select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"), "x", "p", "base", "term")
    keyed = dealt.select("lang", "block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("x").cast("long"), "p", "base", "term")
    shared = keyed.groupBy("lang", "block", "i", "j").applyInArrow(_both_sided, "lang string, lo bigint, hi bigint, f bigint")
    return single.unionByName(shared).groupBy("lang", "lo", "hi").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: partners of each source by distance, and its ``top`` terms above the language.

    Null languages, sources and texts count as empty strings; a row is a document, repeated or not. Groups without
    kept terms have partners and no terms; a language without kept terms has distances of 0. Ties go by UTF-8
    bytes. Other columns are not read. No rows: no rows.
    """
    groups, shares = term_shares(docs, lang, source, text, least_docs)
    size = Observation()
    shares = cut(shares, "shares", (size, F.count(F.lit(1)).alias("n")))
    blocks = max(1, -(-(size.get["n"] or 0) // BLOCK))
    both = source_pairs(groups, shares, blocks)
    turned = both.select("lang", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")), F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")))).alias("e"), "f").select("lang", "e.x", "e.y", "f")
    names = groups.select("lang", F.col("x").cast("long").alias("x"), "source")
    partners = turned.join(names, ["lang", "x"]).join(names.select("lang", F.col("x").alias("y"), F.col("source").alias("item")), ["lang", "y"])

    above = cut(shares.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("f")), "above")
    best = largest(above, ("lang", "source"), "f", "term", top)
    parts = [partners.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("f").alias("value")), best.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.col("f").alias("value"))]
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(order))


#: The same rows in DuckDB SQL, over every kept term and every two sources.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(ln) AS ltotal FROM v GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (v.ln + 5)) // (l.ltotal + 5 * l.v) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0) AS f
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
o AS (SELECT lang, source, part, item, f, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS k FROM r)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM o WHERE part = 'pair' OR k <= 50
"""
