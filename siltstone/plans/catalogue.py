"""All core queries and their DuckDB statements, by name."""

from __future__ import annotations

from siltstone.plans import corpus, measures, selection, structures, training  # noqa: F401
from siltstone.plans.registry import QUERIES, SQL  # noqa: F401
