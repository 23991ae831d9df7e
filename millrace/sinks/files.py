"""Files, partitioned; bucketed ones become a table of the catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks.base import Sink, SinkConfig
from millrace.sources.files import FORMATS
from millrace.storage import filesystem

#: Options that writers of a format take if the spec has them under options.
DEFAULTS: dict[str, dict[str, Any]] = {"csv": {"header": True, "quote": '"', "escape": "\\", "nullValue": ""}}


class FileSink(Sink):
    """path, format (parquet); with bucket_by also table, its name."""

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any], config: SinkConfig | None = None) -> None:
        super().__init__(config)
        self.spark, self.path, self.format, self.table = spark, spec.get("path"), spec.get("format", "parquet"), spec.get("table")
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}; one of {', '.join(FORMATS)}")
        if self.config.mode == "merge":
            raise ValueError("files cannot merge; use a table")
        if self.config.bucket_by and not (self.table and self.config.buckets):
            raise ValueError("bucketing needs a table name and a number of buckets")

    def _write(self, df: DataFrame) -> None:
        c = self.config
        writer = df.write.format(self.format).mode(c.mode).options(**DEFAULTS.get(self.format, {}) | c.options).option("maxRecordsPerFile", c.max_records_per_file)
        if c.compression:
            writer = writer.option("compression", c.compression)
        if c.partition_by:
            writer = writer.partitionBy(*c.partition_by)
        if not c.bucket_by:
            writer.save(self.path)
            return
        writer = writer.bucketBy(c.buckets, *c.bucket_by)
        if c.sort_by:
            writer = writer.sortBy(*c.sort_by)
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def _back(self) -> DataFrame:
        if self.config.bucket_by:
            return self.spark.table(self.table)
        reader = self.spark.read.format(self.format)
        return (reader.options(header=True) if self.format == "csv" else reader).load(self.path)

    def count(self, df: DataFrame) -> int | None:
        return self._back().count()

    def there(self) -> bool:
        if self.config.bucket_by:
            return self.spark.catalog.tableExists(self.table)
        fs, path = filesystem(self.spark, self.path)
        return fs.exists(path)

    def list_output_files(self) -> list[str]:
        return sorted(self._back().inputFiles())
