"""Named queries and the SQL that each has to equal."""

from __future__ import annotations

from . import catalog_etl, catalog_lookup

PARTS = (catalog_lookup, catalog_etl)


def queries() -> dict:
    return {k: f for p in PARTS for k, f in p.QUERIES.items()}


def whole_queries() -> dict:
    """Queries without SQL."""
    return dict(catalog_etl.WHOLE)


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.SQL.items()}
