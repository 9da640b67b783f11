"""Queries over the given test tables, each with the SQL that must give the same rows."""

from framelane.bindings.registry import ORACLES, QUERIES  # noqa: F401
from framelane.bindings import frames, jobs, planning, runs, streams  # noqa: F401,E402
