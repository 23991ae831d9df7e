"""The registered queries of the engine."""

from millrace.queries import aggregates, engine, joins, masks, quality, scans, schemas, streams, tables, windows  # noqa: F401
from millrace.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
