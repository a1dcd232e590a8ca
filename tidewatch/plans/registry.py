"""All queries of the telemetry engine, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewatch.plans import q_align, q_features, q_intervals, q_more

MODULES = (q_align, q_features, q_intervals, q_more)
QUERIES = {k: f for m in MODULES for k, f in m.query.queries.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.query.sql.items()}
