"""Text mining over contracts and pages: paragraphs, rules, values, headings, spans, HTML parts."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinthwork.functions.numbers import as_col
from plinthwork.operators.relational import first_by

# How binding a modal verb is, and the patterns of amounts.
MODALS = ((r"\bshall not\b|\bmust not\b", 0.95), (r"\bshall\b|\bmust\b", 0.90), (r"\bwill\b", 0.80), (r"\bmay\b", 0.40))
DOLLARS, PERCENT = r"\$\s*([\d,]+(?:\.\d{1,2})?)", r"(\d+(?:\.\d+)?)\s*(?:%|percent\b)"
DAYS = r"(\d+)\s*\)?\s*(?:calendar|working|business)?\s*days?\b"
PERIODS = r"\b(hourly|daily|weekly|monthly|annually|per hour|per week|per month|per year)\b"


def modal_weight(x) -> Column:
    low, out = F.lower(as_col(x)), F.lit(0.50)
    for pattern, weight in reversed(MODALS):
        out = F.when(low.rlike(pattern), weight).otherwise(out)
    return out


def values(x) -> Column:
    """Dollars, percents, day counts and periods of a text, each as a list."""
    low, none = F.lower(as_col(x)), F.array().cast("array<string>")
    given = lambda words, found: F.when(F.isnull(as_col(x)), None).when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), found).otherwise(none)  # noqa: E731  a pattern runs where its mark is
    money = F.transform(F.regexp_extract_all(as_col(x), F.lit(DOLLARS), F.lit(1)), lambda v: F.regexp_replace(v, ",", ""))
    return F.struct(
        given(("$",), money).alias("dollars"), given(("%", "percent"), F.regexp_extract_all(low, F.lit(PERCENT), F.lit(1))).alias("percents"), given(("day",), F.regexp_extract_all(low, F.lit(DAYS), F.lit(1))).alias("days"),
        given(("hourly", "daily", "weekly", "monthly", "annually", "per "), F.regexp_extract_all(low, F.lit(PERIODS), F.lit(1))).alias("periods"),
    )


def paragraphs(docs: DataFrame, id: str, text: str, least: int = 80) -> DataFrame:
    """``id, place, start, paragraph``: lines of a text with their offset; short ones are dropped."""
    lines = docs.select(id, F.posexplode(F.split(text, "\n")).alias("place", "paragraph"))
    before = F.sum(F.length("paragraph") + 1).over(Window.partitionBy(id).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("start", F.coalesce(before, F.lit(0))).where(F.length("paragraph") >= least)


def classify(parts: DataFrame, rules: list[tuple[str, str, float, str | None]], text: str, heading: str | None = None, least: float = 0.5) -> DataFrame:
    """Matches of (class, pattern, confidence, heading pattern) rules; a fitting heading adds .05, another takes .15.

    Rules are few and fixed, so they are laid out as one array of structs a row and exploded: no join.
    """
    hits = []
    for name, pattern, confidence, near in rules:
        adjust = F.lit(0.0)
        if near and heading:
            adjust = F.when(F.col(heading).isNull(), 0.0).when(F.lower(heading).rlike(near), 0.05).otherwise(-0.15)
        hits.append(F.when(F.lower(text).rlike(pattern), F.struct(F.lit(name).alias("class"), (F.lit(confidence) + adjust).alias("confidence"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    out = parts.withColumn("__m", F.explode(found)).select(*parts.columns, "__m.class", "__m.confidence")
    return out.where(F.col("confidence") >= least).withColumn("modal", modal_weight(text))


def drop_overlaps(matches: DataFrame, keys: list[str], start: str, end: str, confidence: str) -> DataFrame:
    """Matches of a group, surest first, without those over half covered by one kept before.

    A group (one text's matches) is one array, so many groups go through Python in each Arrow batch.
    """
    rest = [c for c in matches.columns if c not in keys]
    order = F.array_sort(F.collect_list(F.struct((-F.col(confidence)).alias("__c"), F.col(start).alias("__a"), F.col(end).alias("__b"), F.struct(*rest).alias("row"))))
    grouped = matches.groupBy(*keys).agg(order.alias("found"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flags = []
            for group in batch.column(len(keys)).to_pylist():
                kept: list = []
                flags.append([])
                for m in group:
                    a, b = m["__a"], m["__b"]
                    fine = all(min(b, d) - max(a, c) <= 0.5 * min(b - a, d - c) for c, d in kept)
                    flags[-1].append(fine)
                    if fine:
                        kept.append((a, b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.list_(pa.bool_()))], [*batch.schema.names, "fine"])

    kinds = ", ".join(f"`{c}` {grouped.schema[c].dataType.simpleString()}" for c in grouped.columns)
    ran = grouped.mapInArrow(run, kinds + ", fine array<boolean>")
    each = ran.select(*keys, F.explode(F.arrays_zip("found", "fine")).alias("m")).where("m.fine")
    return each.select(*keys, *[F.col(f"m.found.row.{c}").alias(c) for c in rest]).select(*matches.columns)


HEADING = re.compile(r"^(?:ARTICLE|Article|SECTION|Section)\s+([IVXLC]+|\d+)[.:\s-]*(.*)$", re.M)


def articles(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, number, title, start, end, body``: a text cut at its headings; of a repeated number the longest."""
    schema = f"{id} {docs.schema[id].dataType.simpleString()}, number string, title string, start int, end int, body string"

    def run(batches):
        for pdf in batches:
            rows = []
            for key, body in zip(pdf[id], pdf[text]):
                heads = list(HEADING.finditer(body or ""))
                ends = [h.start() for h in heads[1:]] + [len(body or "")]
                best: dict = {}
                for h, e in zip(heads, ends):
                    row = (key, h.group(1), h.group(2).strip(), h.start(), e, body[h.end() : e].strip())
                    if h.group(1) not in best or len(row[5]) > len(best[h.group(1)][5]):
                        best[h.group(1)] = row
                rows += sorted(best.values(), key=lambda r: r[3])
            yield pd.DataFrame(rows, columns=[id, "number", "title", "start", "end", "body"])

    return docs.select(id, text).mapInPandas(run, schema)


def page_of(offset, spans) -> Column:
    """Page whose (start, end) span holds an offset; null where none does."""
    return F.try_element_at(F.transform(F.filter(as_col(spans), lambda s: (s["start"] <= as_col(offset)) & (as_col(offset) < s["end"])), lambda s: s["page"]), F.lit(1))


def link_spans(parts: DataFrame, sections: DataFrame, id: str) -> DataFrame:
    """The section of the same text with the largest overlap, the first of equals; else the one holding the start."""
    j = parts.join(sections.withColumnsRenamed({"start": "s_start", "end": "s_end"}), id)
    overlap = F.greatest(F.least("end", "s_end") - F.greatest("start", "s_start"), F.lit(0))
    j = j.withColumn("overlap", overlap).where((F.col("overlap") > 0) | ((F.col("s_start") <= F.col("start")) & (F.col("start") < F.col("s_end"))))
    return first_by(j, [id, "start", "end"], [F.desc("overlap"), F.asc("s_start")])


def html_text(x) -> Column:
    """Text of a page: scripts, styles, comments and tags off, the common entities resolved, space squeezed."""
    s = F.regexp_replace(as_col(x), r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def rank_text(docs: DataFrame, id: str, text: str, terms: list[str]) -> DataFrame:
    """Texts with all the terms, ranked by their frequency over the text's length."""
    low = F.lower(text)
    counts = [F.regexp_count(low, F.lit(rf"\b{re.escape(t)}\b")) for t in terms]
    total = sum(counts[1:], counts[0])
    out = docs.select(id, *[c.alias(f"__c{i}") for i, c in enumerate(counts)], total.alias("hits"), F.size(F.split(text, r"\s+")).alias("words"))
    for i in range(len(terms)):
        out = out.where(F.col(f"__c{i}") > 0)
    return out.select(id, F.col("hits").cast("long").alias("hits"), (F.col("hits") / F.col("words")).alias("rank"))


def categorised(parts: DataFrame, rules: dict[str, dict], text: str, title: str, parent: str | None = None, least: float = 0.50, shortest: int = 80, longest: int = 3000) -> DataFrame:
    """``parts`` with ``category, class, rule, confidence, modal, matched`` of every pattern that fires in a paragraph.

    ``rules`` maps a category to lists: ``signals`` (pattern, weight) and ``exclusions`` of headings, ``negatives``
    of texts, and ``patterns`` (rule, class, pattern, confidence). A category is shut where the heading or the heading above it is
    excluded, or a negative fires. Signals of the better of both headings, summed to at most 1, add .05 from .5 on
    and take .15 below .3. Confidence is at most .99; paragraphs under ``shortest`` characters do not count, a
    matched text over ``longest`` is cut and marked. Null headings signal nothing. The rules are laid out as one array a row.
    """
    t, heads = F.col(text), [F.coalesce(F.col(c), F.lit("")) for c in (title, parent) if c]
    fires = lambda x, p: F.rlike(x, F.lit(f"(?i){p}"))
    hits = []
    for category, rule in rules.items():
        closed = reduce(Column.__or__, [fires(h, p) for h in heads for p in rule.get("exclusions", [])] + [fires(t, p) for p in rule.get("negatives", [])], F.lit(False))
        points = [F.least(F.lit(1.0), reduce(Column.__add__, [F.when(fires(h, p), w).otherwise(0.0) for p, w in rule.get("signals", [])], F.lit(0.0))) for h in heads]
        score = F.greatest(*points) if len(points) > 1 else points[0]
        adjust = F.when(score >= 0.5, 0.05).when(score >= 0.3, 0.0).otherwise(-0.15)
        for name, kind, pattern, confidence in rule["patterns"]:
            value = F.least(F.lit(0.99), F.lit(confidence) + adjust)
            hits.append(F.when(fires(t, pattern) & ~closed & (value >= least), F.struct(F.lit(category).alias("category"), F.lit(kind).alias("class"), F.lit(name).alias("rule"), value.alias("confidence"))))
    found = parts.where(F.length(F.trim(t)) >= shortest).withColumn("__m", F.explode(F.array_compact(F.array(*hits))))
    cut = F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)
    return found.select(*parts.columns, "__m.category", "__m.class", "__m.rule", "__m.confidence", modal_weight(text).alias("modal"), cut.alias("matched"))
