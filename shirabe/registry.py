"""Every query of the engine by name, and the SQL that says the same."""

from __future__ import annotations

from .plans import checks, families, filters, relations, structures

QUERIES: dict = {**checks.QUERIES, **relations.QUERIES, **structures.QUERIES, **filters.QUERIES, **families.QUERIES}
ORACLE: dict = {**checks.ORACLE, **relations.ORACLE, **structures.ORACLE, **filters.ORACLE, **families.ORACLE}
