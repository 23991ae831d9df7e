"""Kinesis streams; needs a connector jar whose format is aws-kinesis. What becomes of the records needs none."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.jsons import parse_json_columns
from millrace.types import schema_of


def options(spec: Mapping[str, Any]) -> dict[str, str]:
    """Options of a spec: stream, region, endpoint, starting_position (LATEST), options."""
    found = {"kinesis.streamName": spec["stream"], "kinesis.region": spec["region"], "kinesis.startingPosition": spec.get("starting_position", "LATEST")}
    return found | ({"kinesis.endpointUrl": spec["endpoint"]} if spec.get("endpoint") else {}) | dict(spec.get("options", {}))


def read_stream(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """With a schema the JSON fields of the data, else the connector's columns."""
    df = spark.readStream.format(spec.get("format", "aws-kinesis")).options(**options(spec)).load()
    if not (schema := spec.get("schema")):
        return df
    return parse_json_columns(df.withColumnRenamed("data", "value"), schema_of(schema) if isinstance(schema, Mapping) else schema)
