"""Every query of the library by name, and its SQL for DuckDB."""

from __future__ import annotations

from evidra.plans import context, greedy, intervals, more, retrieval, scoring, stores, text  # noqa: F401  they register themselves
from evidra.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
