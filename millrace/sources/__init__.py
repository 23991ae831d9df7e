"""Sources: a spec {type: ..., ...} becomes a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import files, jdbc, kafka, kinesis, rest

REGISTRY: dict[str, Callable[[SparkSession, Mapping[str, Any]], DataFrame]] = {
    "file": files.read,
    "jdbc": jdbc.read,
    "kafka": kafka.read,
    "api": rest.read,
}


def read(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """Reads by the spec's type; `table` is a versioned table, and `delta` one of
    Delta where its jar is there, else a versioned table too."""
    kind = spec.get("type", "jdbc")
    if kind in ("table", "delta"):
        from millrace.tables import delta
        from millrace.tables.store import TableStore

        if kind == "delta" and delta.available(spark):
            return delta.read(spark, spec)
        return TableStore(spark, spec["path"]).read(spec.get("version"), spec.get("timestamp"))
    if kind not in REGISTRY:
        raise ValueError(f"unknown source {kind!r}; one of table, {', '.join(REGISTRY)}")
    return REGISTRY[kind](spark, spec)


def read_stream(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    kind = spec.get("type", "kafka")
    if kind == "kafka":
        return kafka.read_stream(spark, spec)
    if kind == "file":
        return files.read_stream(spark, spec)
    if kind == "kinesis":
        return kinesis.read_stream(spark, spec)
    if kind == "rate":
        return spark.readStream.format("rate").options(**spec.get("options", {})).load()
    raise ValueError(f"unknown stream source {kind!r}; kafka, kinesis, file or rate")
