"""Registered queries: one or more per operator, each with the SQL that defines its result."""

from opsframe.catalog.base import ORACLES, QUERIES
from opsframe.catalog import aggregation, columns, graphs, joining, selection, series, storage, streams  # noqa: F401  (they register queries)

__all__ = ["ORACLES", "QUERIES"]
