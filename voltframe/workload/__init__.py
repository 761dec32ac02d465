"""Registered queries over the given tables."""

from voltframe.workload import curation, forecasting, governance, history  # noqa: F401
from voltframe.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
