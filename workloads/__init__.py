"""Queries over the shared test tables, each with the SQL it must agree with."""

from __future__ import annotations

from workloads.registry import QUERIES, SQL

# Importing a family registers its queries.
from workloads import (  # noqa: F401  isort:skip
    aggregates,
    filters,
    joins,
    lists,
    projections,
    reports,
    scoring,
    storage,
    windows,
)

__all__ = ["QUERIES", "SQL"]
