"""All registered queries and their SQL twins."""

from __future__ import annotations

from plinthwork.plans import analytics, contents, contracts, estimators, filings, forms, linkage, lookups, masters, matching, models, relational, rollups, scorecards, signals, textual, unified

PACKS = [unified, scorecards, relational, matching, analytics, textual, rollups, signals, contracts, forms, linkage, lookups, masters, contents, estimators, lookups, models, filings]


def queries() -> dict:
    return {name: f for pack in PACKS for name, f in pack.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for pack in PACKS for name, sql in pack.SQL.items()}
