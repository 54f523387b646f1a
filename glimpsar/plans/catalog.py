"""All queries over the driver's tables, and the SQL that defines them."""

from __future__ import annotations

from . import evaluation, library, matching, retrieval, scalars, timeline  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
