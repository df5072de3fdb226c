"""Registered queries over the test tables, each with its SQL counterpart where there is one."""

from workloads import histories, joins, logs, options, rollups, shapes, sinks, streams  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
