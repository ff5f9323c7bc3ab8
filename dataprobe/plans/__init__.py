"""Registered queries over the given tables, each with its SQL twin where one exists."""

from dataprobe.plans import basics, generators, learning, profiling, sets, sources, streams  # noqa: F401
from dataprobe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
