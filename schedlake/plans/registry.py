"""All core queries and their SQL twins."""

from __future__ import annotations

from schedlake.plans import display, exports, intake, problems, shelf, tasks, views

_PARTS = (problems, tasks, shelf, exports, intake, display, views)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
