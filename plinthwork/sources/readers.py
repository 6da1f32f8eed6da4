"""Readers of the input formats. Schemas are explicit; no reader infers types from the data."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import sqlite3
import tempfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinthwork.functions.text import blank_to_null


def clean_names(names: list[str]) -> list[str]:
    """Lower-case snake names, never empty, starting with a letter, each once."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", (name or "").lower())).strip("_") or f"column_{i + 1}"
        base = f"c_{base}" if base[0].isdigit() else base
        new, k = base, 2
        while new in out:
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def text_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """Delimited text with a header, all columns strings; compressed files by their ending.

    ``multiline``: quoted values may hold line ends; then a file is one task's work.
    """
    df = spark.read.options(header=True, inferSchema=False, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=multiline).csv(path)
    header = spark.read.option("encoding", encoding).text(path).first()  # Spark itself would number repeated names
    return df.toDF(*clean_names(next(csv.reader([header[0]], delimiter=sep)) if header else []))


def zipped_tables(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Rows of all delimited files inside ZIP archives: ``entry`` and the named columns, as strings.

    An archive is one task's work and is read entry by entry in bounded pieces.
    """

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in sorted(z.namelist()):
                        with z.open(entry) as f:
                            for part in pd.read_csv(f, dtype=str, sep=sep, keep_default_na=False, chunksize=50_000):
                                part.columns = clean_names(list(part.columns))
                                part.insert(0, "entry", entry)
                                yield part.reindex(columns=["entry", *columns])

    schema = ", ".join(f"`{c}` string" for c in ["entry", *columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def zipped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a JSON document inside ZIP archives, parsed to the schema; broken ones give nulls."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in sorted(z.namelist()):
                        yield pd.DataFrame({"entry": [entry], "doc": [z.read(entry).decode("utf-8", "replace")]})

    docs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "entry string, doc string")
    return docs.select("entry", F.from_json("doc", schema).alias("d")).select("entry", "d.*")


def fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int, int, int]]) -> DataFrame:
    """Columns cut from lines by (name, first position from 1, width, implied decimals); blanks are null."""
    cols = []
    for name, at, width, decimals in layout:
        x = blank_to_null(F.substring("value", at, width))
        cols.append((F.expr(f"try_cast(trim(substring(value, {at}, {width})) AS decimal(38,0))") / F.lit(10**decimals) if decimals else x).alias(name))
    return spark.read.text(path).select(*cols)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(content: bytes, sheet: int):
    """Rows of a sheet as lists of strings; gaps are filled."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(_SHEET + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_SHEET + "si")]
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(_SHEET + "row"):
            out: list = []
            for c in row.iter(_SHEET + "c"):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A")).group():
                    at = at * 26 + ord(ch) - 64
                v, inline = c.find(_SHEET + "v"), c.find(f"{_SHEET}is/{_SHEET}t")
                text = (inline.text if inline is not None else None) if v is None else (shared[int(v.text)] if c.get("t") == "s" else v.text)
                out += [None] * (at - 1 - len(out)) + [text]
            yield out


def workbook(spark: SparkSession, path: str, columns: list[str], sheet: int = 1, look: int = 20) -> DataFrame:
    """Rows under the header of a workbook's sheet, as strings; the header is the first row with all the columns.

    A workbook without one in its first ``look`` rows is an error, as it would vanish otherwise.
    """

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows, found = list(_cells(content, sheet)), None
                for i, row in enumerate(rows[:look]):
                    names = clean_names([x or "" for x in row])
                    if set(columns) <= set(names):
                        found = i, names
                        break
                if not found:
                    raise ValueError(f"no header with {columns} in the first {look} rows")
                body = [dict(zip(found[1], row)) for row in rows[found[0] + 1 :] if any(row)]
                yield pd.DataFrame([[r.get(c) for c in columns] for r in body], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def html_tables(pages: DataFrame, id: str, html: str) -> DataFrame:
    """``id, row, cells``: the rows of all tables of a page, tags off."""
    rows = pages.select(id, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", "")))
    return rows.select(id, "row", cells.alias("cells"))


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on SQLite files, each file in a task; the copy it reads lives and dies with the task."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with tempfile.TemporaryDirectory() as d:
                    name = os.path.join(d, "db")
                    with open(name, "wb") as f:
                        f.write(content)
                    con = sqlite3.connect(name)
                    yield from pd.read_sql_query(query, con, chunksize=50_000)
                    con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lambda it: (p.set_axis(names, axis=1) for p in run(it)), schema)


def page_spans(pages: list[str]) -> tuple[str, list[dict]]:
    """Text of pages put together and the span of each; pages are numbered from 1."""
    at, spans = 0, []
    for i, p in enumerate(pages, 1):
        spans.append({"page": i, "start": at, "end": at + len(p)})
        at += len(p)
    return "".join(pages), spans


#: Source adapters: the common column and the source's own, or a literal null.
COMMON = ("id", "name", "state", "city", "zip", "naics", "ein", "address")


def adapt(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A source under the common columns; those it has not are null."""
    return df.select(*[(F.col(mapping[c]).cast("string") if c in mapping else F.lit(None).cast("string")).alias(c) for c in COMMON])


def unmatched(df: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of an adapted source without an active match."""
    return df.join(log.where("status = 'active'").select(F.col("source_id").alias("id")), "id", "left_anti")


def newline_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse_api_page(body: str, items: str) -> list[dict]:
    """Items of one page of a paged service, as the pull step would hand them over."""
    return json.loads(body).get(items, [])
