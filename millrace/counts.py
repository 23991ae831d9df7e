"""Counts that a job makes on its way."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation


def counted(seen: Observation, rows: DataFrame, *aggregates: Column) -> dict[str, Any]:
    """What a finished job observed of rows. Where the optimizer saw that it needs none of them, as behind a filter
    that is never true, the job observed nothing, and the aggregates take a job of their own."""
    try:
        found = seen.get
    except Py4JJavaError:
        found = {}
    return found or rows.agg(*aggregates).first().asDict()
