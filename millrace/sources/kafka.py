"""Kafka topics; needs the spark-sql-kafka jar. What becomes of the records needs no jar."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.jsons import parse_json_columns
from millrace.types import schema_of


def options(spec: Mapping[str, Any]) -> dict[str, str]:
    """Spark's options of a spec: bootstrap_servers, topic, starting_offsets (latest),
    fail_on_data_loss (false), max_offsets_per_trigger, security_protocol and sasl_*."""
    found = {
        "kafka.bootstrap.servers": spec["bootstrap_servers"],
        "subscribe": spec["topic"],
        "startingOffsets": spec.get("starting_offsets", "latest"),
        "failOnDataLoss": str(spec.get("fail_on_data_loss", False)).lower(),
    }
    named = {"max_offsets_per_trigger": "maxOffsetsPerTrigger", "security_protocol": "kafka.security.protocol", "sasl_mechanism": "kafka.sasl.mechanism", "sasl_jaas_config": "kafka.sasl.jaas.config"}
    return found | {v: str(spec[k]) for k, v in named.items() if spec.get(k) is not None} | dict(spec.get("options", {}))


def records(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """With a schema the JSON fields of the value and kafka_timestamp, _partition and _offset."""
    if not (schema := spec.get("schema")):
        return df
    return parse_json_columns(df, schema_of(schema) if isinstance(schema, Mapping) else schema, keep=("timestamp", "partition", "offset"))


def read(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    bounded = {"startingOffsets": spec.get("starting_offsets", "earliest")}
    return records(spark.read.format("kafka").options(**options(spec) | bounded).load(), spec)


def read_stream(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    return records(spark.readStream.format("kafka").options(**options(spec)).load(), spec)
