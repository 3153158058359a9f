"""Queries over the given tables."""

from evidora.catalog import (  # noqa: F401
    aggregates, composites, lookups, projections, streams, tables, texts,
)
from evidora.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
