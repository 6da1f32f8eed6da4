"""Tables of filings as grids, and the directors that five shapes of proxy statements tell of.

A page is read into a tree; its tables become grids in which a cell that spans rows or columns stands in each of its
places. Every reader of a shape gives directors with what it knows; readers are merged in order, the first known
value of a field wins. A filing is read by one task, filings go through Python in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.operators.scoring import likely_name

# How ages, years, committees and headers are worded, titles that end a name, and how many names make a roster.
AGE, SINCE = re.compile(r"\bage[:\s]+(\d{2,3})\b", re.I), re.compile(r"\bdirector\s+since[:\s]+(?:[A-Z][a-z]+\s+)?(\d{4})\b", re.I)
BOARD_SINCE = re.compile(r"\b(?:director|board)\s+(?:since|of\s+the\s+Company\s+since)\s+(\d{4})\b", re.I)
HEADER_SINCE = re.compile(r"\b(?:director\s+since|year\s+first\s+elected|first\s+elected|year\s+elected|elected\s+or\s+appointed)\b", re.I)
COMMITTEES = re.compile(r"\b(audit|compensation|nominating|governance|finance|risk|technology|safety|sustainability)\b", re.I)
INDEPENDENT = re.compile(r"\bindependent\s*[:\-]?\s*(yes|no)\b", re.I)
TITLES = r"Chair(?:man|woman|person)?|President|CEO|CFO|COO|Director|Vice|Senior|Executive|Lead|Independent|Founder|Co-Founder|Retired|Former|Other\s+Public|Prior\s+Public|Skills|Qualifications"
ROSTER, MOST_ROWS, LEAST_BLOCK, MOST_BLOCK, LEAST_SCORE = 4, 10, 50, 5000, 4

_WORD = r"(?:[A-Z][A-Za-z'’\-]+|[A-Z]\.|de|la|van|von|del)"
_NAME = rf"[A-Z][A-Za-z'’.\-]*(?:\s+{_WORD}){{1,4}}(?:,?\s+(?:Jr\.?|Sr\.?|II|III|IV))?"
_BOUND = re.compile(rf"\s+(?:(?:{TITLES})\b|age\b|director\s+since\b)", re.I)
_HONORS = re.compile(r"^(?:Mr|Ms|Mrs|Dr|Hon|The Honorable)\.?\s+", re.I)
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
_CLOSES = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "li": {"li"}, "p": {"p"}}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, *tags: str):
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        parts: list[str] = []
        waiting: list = [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                waiting += reversed(x.children)
        return " ".join(" ".join(parts).replace("\xa0", " ").split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        for closed in _CLOSES.get(tag, ()):
            if self.at.tag == closed:
                self.at = self.at.parent or self.root
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def read_html(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _span(cell: Node, name: str) -> int:
    value = str(cell.attrs.get(name) or "")
    return min(1000, max(1, int(value))) if value.isdigit() else 1


def grid(table: Node) -> list[list[str]]:
    """Texts of a table's own rows; a cell that spans several places stands in each of them, rows are padded to one width."""
    rows: list[list[str]] = []
    taken: dict[tuple[int, int], str] = {}
    own = [r for r in table.all("tr") if next(p for p in _up(r) if p.tag == "table") is table]
    for y, tr in enumerate(own):
        x = 0
        for cell in [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]:
            while (y, x) in taken:
                x += 1
            for dy in range(_span(cell, "rowspan")):
                for dx in range(_span(cell, "colspan")):
                    taken[y + dy, x + dx] = cell.text()
            x += _span(cell, "colspan")
    width = 1 + max((x for _, x in taken), default=-1)
    for y in range(len(own)):
        rows.append([taken.get((y, x), "") for x in range(width)])
    return rows


def _up(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


@dataclass
class Director:
    name: str
    age: int | None = None
    since: int | None = None
    occupation: str | None = None
    independent: bool | None = None
    compensation: float | None = None
    committees: set = field(default_factory=set)
    shape: str = ""


def person(text: str) -> str | None:
    """The name that a text begins with: honours, notes and trailing titles off; null if it is none."""
    s = _HONORS.sub("", re.sub(r"\s*\(\d+\)", "", text.strip(" ,;:.|*")))
    cut = _BOUND.search(s)
    s = (s[: cut.start()] if cut else s).strip(" ,;:.|")
    return s if 4 <= len(s) <= 60 and re.fullmatch(_NAME, s) else None


def _named(text: str) -> list[str]:
    return sorted({m.group(1).title() for m in COMMITTEES.finditer(text)})


def from_small_tables(root: Node) -> list[Director]:
    """One small table a director, with name, age and year in any of its cells."""
    out = []
    for table in root.all("table"):
        rows = grid(table)
        if not rows or len(rows) > MOST_ROWS:
            continue
        text = " ".join(" ".join(dict.fromkeys(r)) for r in rows).replace("|", " ")
        text = " ".join(text.split())
        age, since, name = AGE.search(text), SINCE.search(text), person(text)
        if age and since and name and len(AGE.findall(text)) == 1:  # more ages are more directors
            tail = text[max(age.end(), since.end()) :].strip(" ,;.|")
            out.append(Director(name, int(age[1]), int(since[1]), tail[:400] or None, True if re.search(r"\bindependent\b", text, re.I) else None, None, set(_named(text)), "small_table"))
    return out


def from_summary(root: Node) -> list[Director]:
    """One wide table with a header of names, ages and years: the one with the best header."""
    best: tuple[int, list[list[str]], int] | None = None
    for table in root.all("table"):
        rows = grid(table)
        head = next((i for i, r in enumerate(rows[:3]) if any(r)), None)
        if len(rows) < 5 or head is None:
            continue
        blob = " | ".join(c for c in rows[head] if c).lower()
        if "compensation" in blob or "fees earned" in blob:
            continue
        score = bool(re.search(r"\bname\b", blob)) + 2 * bool(re.search(r"\bage\b", blob)) + 3 * bool(HEADER_SINCE.search(blob)) + 2 * ("independent" in blob) + ("committee" in blob)
        if score >= LEAST_SCORE and (best is None or score > best[0]):
            best = (score, rows, head)
    if best is None:
        return []
    _, rows, head = best
    columns = [c.lower() for c in rows[head]]
    at = lambda test: next((i for i, c in enumerate(columns) if test(c)), None)
    name_at, age_at = at(lambda c: "name" in c), at(lambda c: c.strip() == "age" or c.startswith("age "))
    since_at, independent_at = at(lambda c: bool(HEADER_SINCE.search(c)) or "since" in c), at(lambda c: "independent" in c)
    committee_at = [i for i, c in enumerate(columns) if "committee" in c]
    out = []
    for r in rows[head + 1 :] if name_at is not None else []:
        name = person(r[name_at])
        if name:
            number = lambda i, p: int(m[1]) if i is not None and (m := re.search(p, r[i])) else None  # noqa: B023, E731
            independent = None if independent_at is None else "yes" in r[independent_at].lower() or r[independent_at].strip().lower() == "x"
            out.append(Director(name, number(age_at, r"\b(\d{2,3})\b"), number(since_at, r"(\d{4})"), None, independent, None, {n for i in committee_at for n in _named(r[i])}, "summary"))
    return out


def from_paragraphs(root: Node) -> list[Director]:
    """Running text: a name, then its age in brackets."""
    text, out = root.text(), []
    for m in re.finditer(r"\(\s*age\s+(\d{2,3})\s*\)", text, re.I):
        before = re.search(rf"({_NAME})\s*$", text[max(0, m.start() - 80) : m.start()])
        name = person(before[1]) if before else None
        if name:
            bio = text[m.end() : m.end() + 400].strip(" ,;.")
            since = BOARD_SINCE.search(bio)
            out.append(Director(name, int(m[1]), int(since[1]) if since else None, bio or None, None, None, set(), "paragraph"))
    return out


def from_blocks(root: Node) -> list[Director]:
    """One block a director with age and year; the name leads it, or stands in a cell beside it or in a heading before it."""
    out = []
    for node in root.all("div", "td", "section", "article", "p"):
        text = node.text()
        if not LEAST_BLOCK <= len(text) <= MOST_BLOCK or len(SINCE.findall(text)) != 1:
            continue
        age, since = AGE.search(text.replace("Age -", "Age:")), SINCE.search(text)
        if not (age and since):
            continue
        name = person(text)
        if not name and node.parent is not None:
            beside = [c for c in node.parent.children if isinstance(c, Node) and c is not node]
            place = node.parent.children.index(node)
            before = [c for c in reversed(node.parent.children[:place]) if isinstance(c, Node)]
            name = next((n for c in (beside if node.parent.tag == "tr" else before) if len(c.text()) <= 120 and (n := person(c.text()))), None)
        if name:
            told = INDEPENDENT.search(text)
            out.append(Director(name, int(age[1]), int(since[1]), None, told[1].lower() == "yes" if told else None, None, set(_named(text)), "block"))
    return out


def from_compensation(root: Node) -> list[Director]:
    """The first table of fees: names with the last amount of their rows."""
    for table in root.all("table"):
        rows = grid(table)
        blob = " ".join(rows[0]).lower() if rows else ""
        if len(rows) < 4 or not ("director" in blob and "compensation" in blob or "name" in blob and ("total" in blob or "fees earned" in blob)):
            continue
        out = []
        for r in rows[1:]:
            name = person(r[0])
            amount = next((m[1] for c in reversed(r[1:]) if (m := re.search(r"\$?\s*(\d[\d,]{2,})", c))), None)
            if name and amount:
                out.append(Director(name, compensation=float(amount.replace(",", "")), shape="compensation"))
        if out:
            return out
    return []


def directors(html: str | None) -> list[Director]:
    """All readers in order: a later one runs where the earlier have no roster, the table of fees always; first known values win."""
    root = read_html(html)
    found: list[list[Director]] = []
    for reader in (from_small_tables, from_summary, from_paragraphs, from_blocks):
        if all(len(f) < ROSTER for f in found):
            found.append(reader(root))
    merged: dict[str, Director] = {}
    for d in [d for f in [*found, from_compensation(root)] for d in f]:
        kept = merged.setdefault(d.name.lower(), d)
        for name in ("age", "since", "occupation", "independent", "compensation"):
            if getattr(kept, name) is None:
                setattr(kept, name, getattr(d, name))
        kept.committees |= d.committees
    return list(merged.values())


_DIRECTORS = "array<struct<name: string, age: int, since: int, occupation: string, independent: boolean, compensation: double, committees: array<string>, shape: string>>"


def filed_directors(filings: DataFrame, id: str, html: str) -> DataFrame:
    """``id, name, age, since, occupation, independent, compensation, committees, shape`` of each director; names that no person has are left out. A null page has none."""

    def run(batches):
        for batch in batches:
            found = [[{**d.__dict__, "committees": sorted(d.committees)} for d in directors(h)] for h in batch.column(1).to_pylist()]
            kinds = [("name", pa.string()), ("age", pa.int32()), ("since", pa.int32()), ("occupation", pa.string()), ("independent", pa.bool_()), ("compensation", pa.float64()), ("committees", pa.list_(pa.string())), ("shape", pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct(kinds)))], [id, "found"])

    read = filings.select(id, html).mapInArrow(run, f"`{id}` {filings.schema[id].dataType.simpleString()}, found {_DIRECTORS}")
    return read.select(id, F.explode("found").alias("d")).select(id, "d.*").where(likely_name("name"))


def table_cells(pages: DataFrame, id: str, html: str) -> DataFrame:
    """``id, table, row, column, text``: every place of the grids of a page's tables, numbered from 0."""

    def run(batches):
        for batch in batches:
            grids = [[grid(t) for t in read_html(h).all("table")] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grids, pa.list_(pa.list_(pa.list_(pa.string()))))], [id, "grids"])

    read = pages.select(id, html).mapInArrow(run, f"`{id}` {pages.schema[id].dataType.simpleString()}, grids array<array<array<string>>>")
    rows = read.select(id, F.posexplode("grids").alias("table", "rows")).select(id, "table", F.posexplode("rows").alias("row", "cells"))
    return rows.select(id, "table", "row", F.posexplode("cells").alias("column", "text"))
