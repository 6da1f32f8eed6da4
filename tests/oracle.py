"""Rows of a Spark query and of its SQL twin, in one comparable form."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list):
        return repr([plain(x) for x in v])
    return repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql, sf_dir):
    """What differs between the two, as text; empty if nothing does."""
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.sql(sql)
    b = rows(got.columns, got.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    theirs = dict(zip(got.columns, map(str, got.types)))
    for name, kind in df.dtypes:
        if kind in kinds and theirs[name] != kinds[kind]:
            return f"{name} is {kind} and {theirs[name]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(wrong)} of {len(a[1])} rows, such as {wrong[0]}" if wrong else ("" if a[1] else "no rows")
