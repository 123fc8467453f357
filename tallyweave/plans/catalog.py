"""All queries over the reference's operators, by name, with their DuckDB SQL."""

from __future__ import annotations

from tallyweave.plans import conform, letters, lines, reconcile, sinks, statement, sync, varied, versions  # noqa: F401
from tallyweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
