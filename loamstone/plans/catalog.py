"""All registered core queries."""

from __future__ import annotations

from loamstone.plans import client, maintenance, retrieval  # noqa: F401  (they register their queries)
from loamstone.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
