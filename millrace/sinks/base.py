"""The way of a DataFrame into a sink: hooks, schema check, one write with retries, metrics."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.retry import retried

log = logging.getLogger(__name__)
MODES = ("append", "overwrite", "merge", "error", "ignore")


@dataclass
class SinkConfig:
    mode: str = "append"
    partition_by: list[str] = field(default_factory=list)
    bucket_by: list[str] = field(default_factory=list)
    buckets: int = 0
    sort_by: list[str] = field(default_factory=list)
    compression: str | None = None
    max_records_per_file: int = 1_000_000
    rebalance: bool = False
    merge_schema: bool = False
    merge_keys: list[str] = field(default_factory=list)
    max_retries: int = 3
    retry_delay: float = 1.0
    exponential: bool = True
    on_error: str = "fail"
    quarantine_path: str | None = None
    batch_size: int = 10_000
    validate: bool = False
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {', '.join(MODES)}")
        if self.on_error not in ("fail", "skip", "quarantine"):
            raise ValueError(f"on_error {self.on_error!r}: fail, skip or quarantine")


@dataclass
class Metrics:
    rows: int = 0
    seconds: float = 0.0
    status: str = "success"
    error: str | None = None

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0


class Sink:
    """Subclasses say how to write; count() lets them give the rows back if reading them is cheap, and there()
    whether the target exists."""

    def __init__(self, config: SinkConfig | Mapping[str, Any] | None = None) -> None:
        self.config = config if isinstance(config, SinkConfig) else SinkConfig(**(config or {}))
        self.before: list[Callable[[DataFrame], DataFrame]] = []
        self.after: list[Callable[[Metrics], None]] = []

    def _write(self, df: DataFrame) -> None:
        raise NotImplementedError

    def count(self, df: DataFrame) -> int | None:
        return None

    def there(self) -> bool:
        return False

    def write(self, df: DataFrame) -> Metrics:
        """Hooks before may change the rows, and their errors are errors; those of hooks after are
        logged. The rows are counted by the write itself."""
        began, metrics, config = time.monotonic(), Metrics(), self.config
        for hook in self.before:
            df = hook(df)
        check_columns(df)
        if config.rebalance:
            df = df.hint("rebalance", *config.partition_by)
        try:
            if config.mode == "ignore":
                metrics.rows = self._unless_there(df)
            else:
                metrics.rows = retried(lambda: self._observed(df), config.max_retries, config.retry_delay, config.exponential)
            if config.validate and (found := self.count(df)) is not None and found < metrics.rows:
                raise RuntimeError(f"wrote {metrics.rows} rows but found {found}")
        except Exception as e:
            metrics.error, metrics.status = str(e), {"fail": "failed", "skip": "skipped", "quarantine": "quarantined"}[config.on_error]
            if config.on_error == "fail":
                raise
            log.warning("write failed: %s", e)
            if config.on_error == "quarantine":
                quarantine(df, str(e), config.quarantine_path)
        metrics.seconds = time.monotonic() - began
        for hook in self.after:
            try:
                hook(metrics)
            except Exception as e:
                log.warning("hook failed: %s", e)
        return metrics

    def _unless_there(self, df: DataFrame) -> int:
        """No rows are written where the target exists; one that comes up meanwhile is an error. Without retries,
        since what a failed write leaves would count as being there."""
        if self.there():
            return 0
        asked = self.config
        self.config = replace(asked, mode="error")
        try:
            return self._observed(df)
        finally:
            self.config = asked

    def _observed(self, df: DataFrame) -> int:
        """The rows of a write that takes place; one that does not would be waited for in vain."""
        seen = Observation()
        self._write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return seen.get.get("n", 0)


def check_columns(df: DataFrame) -> None:
    names = [c.lower() for c in df.columns]
    if not names:
        raise ValueError("no columns to write")
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"columns twice: {twice}")


def quarantine(df: DataFrame, error: str, path: str | None) -> None:
    if not path:
        raise ValueError("quarantine needs a path")
    marked = df.withColumns({"_error_message": F.lit(error[:1000]), "_quarantine_timestamp": F.current_timestamp()})
    marked.write.mode("append").parquet(path)


def sink_for(spark, spec: Mapping[str, Any]) -> Sink:
    """type: file, table (or delta), jdbc, kafka, api; the other entries are the sink's and SinkConfig's."""
    from millrace.sinks import files, jdbc, kafka, rest, table

    kinds = {"file": files.FileSink, "table": table.TableSink, "delta": table.DeltaSink, "jdbc": jdbc.JdbcSink, "kafka": kafka.KafkaSink, "api": rest.RestSink}
    kind = spec.get("type", "table")
    if kind not in kinds:
        raise ValueError(f"unknown sink {kind!r}; one of {', '.join(kinds)}")
    known = SinkConfig.__dataclass_fields__
    config = SinkConfig(**{k: v for k, v in spec.items() if k in known})
    return kinds[kind](spark, {k: v for k, v in spec.items() if k not in known and k != "type"}, config)


