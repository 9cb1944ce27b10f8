"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lattica.queries import formats, recursive, relational, scalars, streams

MODULES = (recursive, relational, scalars, streams, formats)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
