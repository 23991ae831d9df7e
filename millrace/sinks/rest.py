"""REST endpoints: executors post batches of JSON, each with a key by which a repeat can be told."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sinks.base import Sink, SinkConfig
from millrace.shipping import ship
from millrace.sources.rest import fetch


class RestSink(Sink):
    """url, method (POST), headers, auth, rate_limit (requests a second and task), timeout. Each
    request is tried again by itself; the write as a whole is not."""

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any], config: SinkConfig | None = None) -> None:
        super().__init__(config)
        self.spec = dict(spec) | {"max_retries": self.config.max_retries, "retry_delay": self.config.retry_delay}
        self.spec["headers"] = {"Content-Type": "application/json"} | dict(spec.get("headers") or {})
        self.config.max_retries = 0

    def _write(self, df: DataFrame) -> None:
        ship(df.sparkSession)
        spec, size = self.spec, self.config.batch_size

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = 0
            for batch in batches:
                rows = batch.column("row").to_pylist()
                for at in range(0, len(rows), size):
                    begun = time.monotonic()
                    body = ("[" + ",".join(rows[at : at + size]) + "]").encode()
                    key = hashlib.sha256(body).hexdigest()
                    fetch(spec["url"], spec | {"headers": spec["headers"] | {"Idempotency-Key": key}}, body, spec.get("method", "POST"))
                    sent += len(rows[at : at + size])
                    if spec.get("rate_limit"):
                        time.sleep(max(0.0, 1 / float(spec["rate_limit"]) - (time.monotonic() - begun)))
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], ["sent"])

        df.select(F.to_json(F.struct("*")).alias("row")).mapInArrow(send, "sent long").agg(F.sum("sent")).collect()


