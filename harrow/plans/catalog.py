"""All queries of the engine's own operators, and the SQL that each is checked against."""

from __future__ import annotations

from harrow.plans import artifacts, calls, graphs, logs, rounds, scoring, stats, streams, text, traces

MODULES = [scoring, rounds, stats, text, graphs, calls, traces, streams, logs, artifacts]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
