"""All queries of the library, and the SQL that checks them."""

from __future__ import annotations

from .plans import chemistry, files, flows, frames, graphs, reports

_PARTS = (frames, graphs, reports, chemistry, flows, files)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
