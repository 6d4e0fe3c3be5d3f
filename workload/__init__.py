"""Queries over the test tables, each with the SQL that checks it where SQL can express it."""

from workload import detectors, learning, profile, spectral, tables  # noqa: F401  (registers queries)
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
