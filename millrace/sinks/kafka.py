"""Kafka topics; needs the spark-sql-kafka jar."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.functions.jsons import kafka_columns
from millrace.sinks.base import Sink, SinkConfig


class KafkaSink(Sink):
    """bootstrap_servers, topic, key_column, value_columns. A write that failed may have sent messages, so it
    is not tried again as a whole; Kafka's own producer retries what it can tell apart."""

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any], config: SinkConfig | None = None) -> None:
        super().__init__(config)
        self.spec = spec
        self.config.max_retries = 0

    def messages(self, df: DataFrame) -> DataFrame:
        return kafka_columns(df, self.spec.get("key_column"), self.spec.get("value_columns"))

    def _options(self) -> dict[str, Any]:
        return {"kafka.bootstrap.servers": self.spec["bootstrap_servers"], "topic": self.spec["topic"]} | self.config.options

    def _write(self, df: DataFrame) -> None:
        self.messages(df).write.format("kafka").options(**self._options()).save()

    def stream_writer(self, df: DataFrame) -> DataStreamWriter:
        return self.messages(df).writeStream.format("kafka").options(**self._options())

    def write_stream(self, df: DataFrame, checkpoint: str, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
        from millrace.streaming.run import triggered

        return triggered(self.stream_writer(df).option("checkpointLocation", checkpoint), trigger or {"type": "micro_batch"}).start()
