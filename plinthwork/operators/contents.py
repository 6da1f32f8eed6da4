"""Contents pages of contracts and the sections they announce: entries, page offset by voting, monotone alignment.

A contents block is the lines after its header, or else the densest cluster of lines with leaders near the
beginning. The printed page of an entry and the page on which its heading is found differ by one offset for the
whole document, which is the one that most pairs of entry and heading agree on. Headings are then aligned with the
entries in order, by dynamic programming over their places, so an entry with a wrong page, or one whose title occurs
in other places, still finds its own heading, and no character belongs to two sections.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a contents block, its entries and its noise look like, and how far it is searched for.
HEADER = re.compile(r"TABLE\s+OF\s+CONTENTS", re.I)
LEADER = "[.·…]"
NUMERAL = r"[IVXLC]{1,7}|\d{1,3}"
CONTINUED = re.compile(r"\(cont['’]?d\)|\(continued\)", re.I)
NOISE = re.compile(r"\s*(?:|page|-\s*\d+\s*-|i{1,3}|iv|vi{0,3}|ix|x{0,3})\s*", re.I)
HEADER_PART, LEAST_PART, CLUSTER_PART, CLUSTER_LINES, CLUSTER_LEAST, MOST_NOISE, SHORT_TITLE, LONGEST_TITLE = 4, 2000, 7, 60, 5, 8, 40, 160

_PAGED = re.compile(rf"(?P<indent>[ \t]*)(?P<rest>\S.*?)\s*{LEADER}{{2,}}\s*(?P<page>\d{{1,4}})\s*")
_NUMBERED = re.compile(rf"(?:ARTICLE\s+)?(?P<number>{NUMERAL})(?:[.):\-]\s*|\s+)(?P<title>\S.*)", re.I)
_DOTS = re.compile(rf"{LEADER}{{4,}}")
_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


class Entry(NamedTuple):
    number: str
    title: str
    page: int
    level: int
    parent: str | None


class Section(NamedTuple):
    number: str
    title: str
    level: int
    parent: str | None
    start: int
    end: int
    page_start: int | None
    page_end: int | None


def arabic(number: str) -> str:
    """A well-formed roman numeral as digits; anything else as it is."""
    n = number.strip().upper()
    if not n or set(n) - set(_VALUES):
        return number.strip()
    values = [_VALUES[c] for c in n]
    total = sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))
    return str(total) if roman(total) == n else number.strip()


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + sign * (n // value), n % value
    return out


def _clean(title: str) -> str:
    return " ".join(title.split()).strip("-:.·… ")


def _numbered(line: str) -> tuple[str, str] | None:
    """Number and title of a line that begins with a number or a well-formed numeral."""
    m = _NUMBERED.fullmatch(line.strip())
    number = arabic(m["number"]) if m else ""
    return (number, m["title"]) if number.isdigit() else None


def _block(text: str) -> list[str]:
    """Lines among which the contents are, or none."""
    found = HEADER.search(text, 0, max(len(text) // HEADER_PART, LEAST_PART))
    if found:
        return text[found.end() :].split("\n")
    lines = text[: len(text) // CLUSTER_PART].split("\n")
    at = [i for i, line in enumerate(lines) if re.fullmatch(rf".+?{LEADER}{{3,}}\s*\d+\s*", line)]
    spans = [(bisect.bisect_right(at, a + CLUSTER_LINES) - k, -k) for k, a in enumerate(at)]
    n, k = max(spans, default=(0, 0))
    return lines[max(0, at[-k] - 2) : at[-k + n - 1] + 3] if n >= CLUSTER_LEAST else []


def contents(text: str | None) -> list[Entry]:
    """Entries of a text's contents, in order; a title may run over two lines, and a continued header repeats no entry."""
    out: list[Entry] = []
    article, held, idle = None, "", 0
    for line in _block(text or ""):
        if idle > MOST_NOISE:
            break
        if NOISE.fullmatch(line):
            idle, held = idle + 1, ""
            continue
        if CONTINUED.search(line):
            if m := _numbered(line):
                article = m[0]
            idle, held = 0, ""
            continue
        paged = _PAGED.fullmatch(line)
        if not paged:
            # A title that goes on: a numbered line without a page of its own, then others.
            more = f"{held} {line.strip()}" if held and len(held) + len(line) < LONGEST_TITLE else ""
            held, idle = (line.rstrip() if _numbered(line) else more), idle + 1
            continue
        rest, page, deep = paged["rest"], int(paged["page"]), bool(paged["indent"])
        m = _numbered(rest)
        if held and not m:
            rest, deep = f"{held.strip()} {rest}", held[:1] in " \t"
            m = _numbered(rest)
        held, idle = "", 0
        if m and deep and article and rest[:1].isdigit():
            out.append(Entry(f"{article}.{m[0]}", _clean(m[1]), page, 2, article))
        elif m:
            article = m[0]
            out.append(Entry(article, _clean(m[1]), page, 1, None))
        else:
            title = _clean(rest)
            wraps = out and out[-1].page == page and out[-1].number != out[-1].title and len(out[-1].title) < SHORT_TITLE
            if wraps:
                out[-1] = out[-1]._replace(title=f"{out[-1].title} {title}")
            elif len(title) >= 3 and title[0].isupper() and title.lower() != "index":
                out.append(Entry(title, title, page, 1, None))
                article = None
    return out


def _heading(entry: Entry) -> re.Pattern:
    """What the heading of an entry looks like at the start of a line; the number is optional and told apart by a group."""
    title = r"\s+".join(map(re.escape, entry.title[:60].split()))
    if entry.number == entry.title:
        return re.compile(rf"^[ \t]*(?P<title>{title})", re.I | re.M)
    last = entry.number.rsplit(".", 1)[-1]
    forms = {entry.number, last} | ({roman(int(last))} if last.isdigit() and "." not in entry.number else set())
    number = "|".join(sorted(map(re.escape, forms), key=len, reverse=True))
    return re.compile(rf"^[ \t]*(?:(?P<number>(?:ARTICLE\s+)?(?:{number})[.\s:)\-]+)\s*)?(?P<title>{title})", re.I | re.M)


def _places(text: str, entry: Entry) -> list[tuple[int, bool]]:
    """Starts of possible headings, and whether the number is with them; contents lines are none."""
    out = []
    for m in _heading(entry).finditer(text):
        stop = text.find("\n", m.end())
        if not _DOTS.search(text, m.start(), stop if stop >= 0 else len(text)):
            out.append((m.start(), entry.number == entry.title or bool(m["number"])))
    return out


def split_sections(text: str, spans: list[tuple[int, int, int]], entries: list[Entry]) -> list[Section]:
    """Sections of a text from the first aligned heading on; ``spans`` are (page, start, end). Entries without a heading are left out."""
    starts = [s for _, s, _ in spans]

    def page_of(at: int) -> int | None:
        k = bisect.bisect_right(starts, at) - 1
        return spans[k][0] if k >= 0 and at < spans[k][2] else None

    places = [_places(text, e) for e in entries]
    votes = Counter(p - e.page for e, found in zip(entries, places) for at, named in found if named and (p := page_of(at)) is not None and p >= e.page)
    offset = min(votes, key=lambda o: (-votes[o], o), default=0)

    # Best chain of headings in the order of entries: each step scores a heading, most for one on its page with its number.
    tops: list[tuple[int, float, tuple | None]] = [(-1, 0.0, None)]  # by place, scores rising: the best chain that ends there
    for k, (e, found) in enumerate(zip(entries, places)):
        new = []
        for at, named in found:
            page = page_of(at)
            score = 1.0 + 2.0 * named + (1.0 if page == e.page + offset else 0.5 if page is not None and abs(page - e.page - offset) <= 1 else 0.0)
            before = tops[bisect.bisect_left(tops, at, key=lambda t: t[0]) - 1]
            new.append((at, before[1] + score, (k, at, before[2])))
        for item in new:
            i = bisect.bisect_left(tops, item[0], key=lambda t: t[0])
            if tops[i - 1][1] >= item[1] or i < len(tops) and tops[i][0] == item[0] and tops[i][1] >= item[1]:
                continue
            tops.insert(i, item)
            while i + 1 < len(tops) and tops[i + 1][1] <= item[1]:
                del tops[i + 1]
    node, taken = tops[-1][2], []
    while node:
        taken.append((entries[node[0]], node[1]))
        node = node[2]
    taken.reverse()
    ends = [at for _, at in taken[1:]] + [len(text)]
    return [Section(e.number, e.title, e.level, e.parent, at, end, page_of(at), page_of(max(at, end - 1))) for (e, at), end in zip(taken, ends)]


_ENTRIES = "array<struct<number: string, title: string, page: int, level: int, parent: string>>"
_SECTIONS = "array<struct<number: string, title: string, level: int, parent: string, start: int, end: int, page_start: int, page_end: int>>"


def with_sections(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with ``entries`` and ``sections``; ``spans`` is an array of (page, start, end) by start. Nulls count as empty.

    A text is read by one task; texts go through Python in Arrow batches, and only the two columns are looked at.
    """
    clash = [c for c in docs.columns if c not in ("entries", "sections")]
    given = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), F.transform(F.coalesce(F.col(spans), F.array()), lambda s: F.array(s["page"].cast("long"), s["start"].cast("long"), s["end"].cast("long"))).alias("__spans"), *clash)

    def run(batches):
        for batch in batches:
            entries, sections = [], []
            for body, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = contents(body)
                entries.append([e._asdict() for e in found])
                sections.append([s._asdict() for s in split_sections(body, pages, found)] if found else [])
            kinds = [pa.list_(pa.struct([(n, pa.int32() if n in ("page", "level", "start", "end", "page_start", "page_end") else pa.string()) for n in t._fields])) for t in (Entry, Section)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(entries, kinds[0]), pa.array(sections, kinds[1])], [*batch.schema.names[2:], "entries", "sections"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in clash]
    return given.mapInArrow(run, ", ".join([*kinds, f"entries {_ENTRIES}, sections {_SECTIONS}"]))


# Paragraphs of a section

# Words that carry a paragraph on, and what a heading begins with.
CARRIES = r"(?i)^(?:and|or|but|provided|except|however|furthermore|moreover|additionally|including)\b"
HEADS = r"^(?:ARTICLE|SECTION|Art\.|Sec\.)\s"
LEAST_PARAGRAPH, SHORT_PARAGRAPH = 80, 120


def whole_paragraphs(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``*keys, start, paragraph``: blank-line parts of a text, fragments joined to the part before, short ones dropped.

    A part is a fragment if it begins in lower case or with a connecting word, or if the part before ends without
    a stop and it is short and no heading. Built-in functions only: one fold over the parts of each text.
    """
    none = F.array().cast("array<struct<start: int, paragraph: string>>")
    body = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    parts = F.filter(F.split("__t", r"\n\s*\n"), lambda p: p.rlike(r"\S"))

    def place(acc, part):
        at = F.call_function("locate", part, F.col("__t"), acc["at"])  # from where the last part ended
        lead = F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
        found = F.struct((at - 1 + lead).alias("start"), F.regexp_replace(part, r"^\s+|\s+$", "").alias("paragraph"))
        return F.struct((at + F.length(part)).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def join(acc, part):
        last, p = F.element_at(acc, -1), part["paragraph"]
        open_ = ~last["paragraph"].rlike(r"[.!?;:]$") & ~p.rlike(HEADS) & p.rlike(r"^\p{Lu}") & (F.length(p) < SHORT_PARAGRAPH)
        longer = F.struct(last["start"].alias("start"), F.concat(last["paragraph"], F.lit(" "), p).alias("paragraph"))
        return F.when((F.size(acc) > 0) & (p.rlike(r"^\p{Ll}") | p.rlike(CARRIES) | open_), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(part)))

    placed = body.select(*keys, F.aggregate(parts, F.struct(F.lit(1).alias("at"), none.alias("out")), place, lambda acc: acc["out"]).alias("__q"))
    merged = placed.select(*keys, F.explode(F.aggregate("__q", none, join)).alias("__m"))
    return merged.select(*keys, "__m.start", "__m.paragraph").where(F.length("paragraph") >= LEAST_PARAGRAPH)
