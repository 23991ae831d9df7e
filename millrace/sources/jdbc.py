"""Tables and queries of databases."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import embedded
from millrace.types import driver_of


def read(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """url; query or table (the query counts); user, password, driver, fetchsize, options.

    With partition_column, lower_bound, upper_bound and num_partitions the table, or the query as a
    subquery, is read in parallel; the bounds only shape the stride and leave no row out.

    Of a database in the driver's process, where executors are others, the rows are those at the time of the
    call: the driver reads them into files."""
    query, table = spec.get("query"), spec.get("table")
    if not query and not table:
        raise ValueError("a JDBC source needs a table or a query")
    options = {"url": spec["url"], "driver": spec.get("driver") or driver_of(spec["url"])}
    options |= {k: spec[k] for k in ("user", "password", "fetchsize") if spec.get(k) is not None}
    if column := spec.get("partition_column"):
        options |= {
            "dbtable": f"({query}) millrace_source" if query else table,
            "partitionColumn": column,
            "lowerBound": spec.get("lower_bound", 0),
            "upperBound": spec.get("upper_bound", 1_000_000),
            "numPartitions": spec.get("num_partitions", 4),
        }
    else:
        options |= {"query": query} if query else {"dbtable": table}
    found = spark.read.format("jdbc").options(**options, **spec.get("options", {})).load()
    return embedded.fetched(found) if embedded.out_of_reach(spark, spec["url"]) else found


def works(spark: SparkSession, spec: Mapping[str, Any]) -> bool:
    """Does a query of one row succeed?"""
    probe = "VALUES 1" if ":derby:" in spec["url"] else "SELECT 1 FROM dual" if ":oracle:" in spec["url"] else "SELECT 1"
    try:
        with connection(spark, spec) as c:
            return c.createStatement().executeQuery(probe).next()
    except Exception:  # any failure is the answer
        return False


class connection:  # noqa: N801
    """A java.sql.Connection of the driver's JVM, closed at the end of a with block."""

    def __init__(self, spark: SparkSession, spec: Mapping[str, Any]) -> None:
        self.spark, self.spec = spark, spec

    def __enter__(self) -> Any:
        jvm = self.spark._jvm
        jvm.org.apache.spark.util.Utils.classForName(self.spec.get("driver") or driver_of(self.spec["url"]), True, False)
        info = jvm.java.util.Properties()
        for k in ("user", "password"):
            if self.spec.get(k) is not None:
                info.setProperty(k, self.spec[k])
        self.open = jvm.java.sql.DriverManager.getConnection(self.spec["url"], info)
        return self.open

    def __exit__(self, *_: object) -> None:
        self.open.close()


def execute(spark: SparkSession, spec: Mapping[str, Any], *statements: str) -> None:
    """Runs statements that return no rows."""
    with connection(spark, spec) as c:
        for sql in statements:
            c.createStatement().execute(sql)
