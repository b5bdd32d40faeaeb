"""All queries of the plans, and the SQL that checks them."""

from __future__ import annotations

from tarnwright.plans import corpora, relational, shapes, stateful

__all__ = ["ORACLE_SQL", "QUERIES", "corpora", "shapes", "stateful"]

#: The other modules register theirs here too.
QUERIES, ORACLE_SQL = relational.QUERIES, relational.ORACLE_SQL
