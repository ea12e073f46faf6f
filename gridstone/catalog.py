"""Every query by name, with its SQL for comparison."""

from __future__ import annotations

from . import plans
from .plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    plans.load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    plans.load()
    return dict(SQL)
