"""Versioned tables, and those of Delta where its jar is there."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks.base import Sink, SinkConfig
from millrace.storage import filesystem
from millrace.tables import delta
from millrace.tables.store import TableStore


class TableSink(Sink):
    """path; replace_where; and for merge the clauses of TableStore.merge."""

    CLAUSES = ("update_condition", "update_set", "insert_condition", "insert_values", "delete_condition")

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any], config: SinkConfig | None = None) -> None:
        super().__init__(config)
        self.store, self.spec = TableStore(spark, spec["path"]), spec
        if self.config.mode == "merge" and not self.config.merge_keys:
            raise ValueError("a merge needs merge_keys")

    def _write(self, df: DataFrame) -> None:
        c = self.config
        if c.mode == "merge":
            self.store.merge(df, c.merge_keys, **{k: self.spec[k] for k in self.CLAUSES if k in self.spec})
        elif where := self.spec.get("replace_where"):
            self.store.replace_where(df, where)
        else:
            options = {"maxRecordsPerFile": c.max_records_per_file} | ({"compression": c.compression} if c.compression else {}) | c.options
            self.store.write(df, c.mode, c.partition_by, c.merge_schema, options=options)

    def count(self, df: DataFrame) -> int | None:
        return self.store.manifest()["rows"]

    def there(self) -> bool:
        return self.store.exists()


class DeltaSink(TableSink):
    """The same spec for a Delta table; without the jar it is a versioned table."""

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any], config: SinkConfig | None = None) -> None:
        super().__init__(spark, spec, config)
        self.spark = spark

    def _write(self, df: DataFrame) -> None:
        if not delta.available(self.spark):
            super()._write(df)
            return
        c = self.config
        delta.write(df, self.spec["path"], c.mode, c.partition_by, c.merge_schema, c.merge_keys, self.spec, c.options)

    def count(self, df: DataFrame) -> int | None:
        if not delta.available(self.spark):
            return super().count(df)
        return delta.read(self.spark, {"path": self.spec["path"]}).count()

    def there(self) -> bool:
        if not delta.available(self.spark):
            return super().there()
        fs, path = filesystem(self.spark, self.spec["path"])
        return fs.exists(path)
