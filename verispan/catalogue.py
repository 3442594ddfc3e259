"""All queries of the engine but the training-data ones, and the SQL that says the same."""

from __future__ import annotations

from .plans import linear, records, relational, statistics, text
from .plans.registry import Query

CATALOGUES = (relational.catalogue, text.catalogue, statistics.catalogue, linear.catalogue, records.catalogue)


def queries() -> dict[str, Query]:
    return {name: f for c in CATALOGUES for name, f in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for c in CATALOGUES for name, sql in c.sql.items()}
