"""Starts, watches and stops streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.sinks.kafka import KafkaSink
from millrace.sources import read_stream
from millrace.streaming.ops import split_steps, transform
from millrace.tables.store import TableStore


def triggered(writer: DataStreamWriter, trigger: Mapping[str, Any]) -> DataStreamWriter:
    match trigger.get("type", "micro_batch"):
        case "micro_batch":
            return writer.trigger(processingTime=trigger.get("interval", "10 seconds"))
        case "continuous":
            return writer.trigger(continuous=trigger.get("interval", "1 second"))
        case "once" | "available_now":
            return writer.trigger(availableNow=True)
        case other:
            raise ValueError(f"unknown trigger {other!r}; micro_batch, continuous, once or available_now")


def to_table(df: DataFrame, path: str, query_name: str, merge_keys: Sequence[str] = (), prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Every batch is one commit of a versioned table; a batch that is repeated after a failure is
    found in the manifest and skipped, so each counts once."""

    def commit(batch: DataFrame, number: int) -> None:
        store = TableStore(batch.sparkSession, path)
        rows = prepare(batch) if prepare else batch
        if merge_keys:
            store.merge(rows, list(merge_keys), transaction=(query_name, number))
        else:
            store.write(rows, "append", transaction=(query_name, number))

    return df.writeStream.foreachBatch(commit)


def start(spark: SparkSession, spec: Mapping[str, Any]) -> StreamingQuery:
    """A spec {pipeline_id, source, transforms, target {type: table|file|kafka|memory|console, path, ...},
    output_mode, trigger, checkpoint_location}; runs until it is stopped or has nothing left.

    Steps that need whole batches, and those behind them, run on each batch before it is committed to
    a table; other targets cannot have them."""
    name, target, mode = spec["pipeline_id"], spec["target"], spec.get("output_mode", "append")
    steps, later = split_steps(spec.get("transforms", []))
    df = transform(read_stream(spark, spec["source"]), steps)
    if mode == "append" and any(s.get("type") in ("aggregate", "session") for s in steps) and not any(s.get("type") == "watermark" for s in steps):
        raise ValueError("an aggregate in append mode needs a watermark before it")
    kind = target.get("type", "table")
    if later and kind not in ("table", "delta"):
        raise ValueError(f"{later[0]['type']} needs whole batches, which only a table takes")
    if kind in ("table", "delta"):
        writer = to_table(df, target["path"], name, target.get("merge_keys", ()), (lambda batch: transform(batch, later)) if later else None)
    elif kind == "kafka":
        writer = KafkaSink(spark, target).stream_writer(df)
    elif kind == "file":
        writer = df.writeStream.format(target.get("format", "parquet")).option("path", target["path"])
        writer = writer.partitionBy(*target["partition_by"]) if target.get("partition_by") else writer
    elif kind in ("memory", "console", "noop"):
        writer = df.writeStream.format(kind)
    else:
        raise ValueError(f"unknown stream target {kind!r}; table, file, kafka, memory, console or noop")
    writer = writer.outputMode(mode).queryName(name)
    if location := spec.get("checkpoint_location"):
        writer = writer.option("checkpointLocation", f"{location.rstrip('/')}/{name}")
    return triggered(writer, spec.get("trigger", {})).start()


def watch(query: StreamingQuery, max_runtime: float | None = None, poll: float = 1.0) -> dict[str, Any]:
    """Waits for the end, or stops the query after max_runtime seconds. A query that failed raises its
    error. Returns batches and input rows, each batch counted once."""
    began, seen = time.monotonic(), {}
    while True:
        over = query.awaitTermination(poll)
        for p in query.recentProgress:
            seen[p["batchId"]] = p["numInputRows"]
        if over:
            break
        if max_runtime is not None and time.monotonic() - began >= max_runtime:
            query.stop()
            break
    return {"batches": len(seen), "rows": sum(seen.values()), "seconds": time.monotonic() - began}


def stop_all(spark: SparkSession) -> int:
    running = spark.streams.active
    for query in running:
        query.stop()
    return len(running)
