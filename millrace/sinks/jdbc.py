"""Tables of databases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks.base import Sink, SinkConfig
from millrace.sources import embedded
from millrace.sources.jdbc import execute
from millrace.types import create_jdbc_table, driver_of


class JdbcSink(Sink):
    """url, table, user, password, driver, num_partitions, isolation_level, truncate,
    create_table_options. A merge appends. Retries repeat a write: only an overwrite is safe then, so
    an append is not tried again. A database in the driver's process, where executors are others, is
    written by the driver."""

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any], config: SinkConfig | None = None) -> None:
        super().__init__(config)
        self.spark, self.spec = spark, spec
        if self.config.mode != "overwrite":
            self.config.max_retries = 0

    def _options(self) -> dict[str, Any]:
        named = {"user": "user", "password": "password", "num_partitions": "numPartitions", "isolation_level": "isolationLevel", "truncate": "truncate", "create_table_options": "createTableOptions", "column_types": "createTableColumnTypes"}
        given = {v: self.spec[k] for k, v in named.items() if self.spec.get(k) is not None}
        return {"url": self.spec["url"], "dbtable": self.spec["table"], "driver": self.spec.get("driver") or driver_of(self.spec["url"]), "batchsize": self.config.batch_size} | given | self.config.options

    def _write(self, df: DataFrame) -> None:
        mode = "append" if self.config.mode == "merge" else self.config.mode
        df.write.format("jdbc").mode(mode).options(**self._options()).save()

    def _observed(self, df: DataFrame) -> int:
        if not embedded.out_of_reach(self.spark, self.spec["url"]):
            return super()._observed(df)
        self._write(df.limit(0))  # makes or empties the table; of no rows there are no tasks
        return embedded.insert(df, self._options())

    def _back(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(**{k: v for k, v in self._options().items() if k in ("url", "dbtable", "driver", "user", "password")}).load()

    def count(self, df: DataFrame) -> int | None:
        back = self._back()
        return (embedded.fetched(back) if embedded.out_of_reach(self.spark, self.spec["url"]) else back).count()

    def there(self) -> bool:
        try:
            return bool(self._back().columns)
        except Exception:  # no such table; if it is the connection that fails, the write says so
            return False

    def execute_query(self, *statements: str) -> None:
        execute(self.spark, self.spec, *statements)

    def create_table(self, df: DataFrame, primary_keys: Sequence[str] = ()) -> None:
        self.execute_query(create_jdbc_table(self.spec["table"], df.schema, primary_keys))
