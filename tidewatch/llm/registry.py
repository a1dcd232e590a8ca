"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewatch.llm import queries_free, queries_native

QUERIES = {**queries_free.QUERIES, **queries_native.QUERIES}
ORACLE_SQL = {**queries_free.ORACLE_SQL, **queries_native.ORACLE_SQL}
