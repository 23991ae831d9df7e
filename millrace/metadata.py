"""Tables, columns, keys and indexes of a database, from its JDBC metadata."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession

from millrace.sources.jdbc import connection
from millrace.types import Column, Database, Table

log = logging.getLogger(__name__)


def _rows(result: Any) -> Iterator[Any]:
    while result.next():
        yield result


def extract(spark: SparkSession, spec: Mapping[str, Any], tables: Sequence[str] | None = None, schema: str | None = None) -> Database:
    """All tables of a schema, or those named. A table that cannot be read is logged and left out."""
    found = Database(spec["url"].removeprefix("jdbc:").split(":")[0])
    with connection(spark, spec) as open_:
        meta = open_.getMetaData()
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        names = [(r.getString("TABLE_SCHEM"), r.getString("TABLE_NAME")) for r in _rows(meta.getTables(None, schema, "%", kinds))]
        for where, name in names:
            if tables is not None and name.lower() not in {t.lower() for t in tables}:
                continue
            try:
                found.tables[name] = _table(meta, where, name)
            except Exception as e:
                log.warning("table %s: %s", name, e)
    return found


def _table(meta: Any, schema: str | None, name: str) -> Table:
    keys = [k for _, k in sorted((r.getInt("KEY_SEQ"), r.getString("COLUMN_NAME")) for r in _rows(meta.getPrimaryKeys(None, schema, name)))]
    columns = []
    for r in _rows(meta.getColumns(None, schema, name, "%")):
        size = r.getInt("COLUMN_SIZE")
        kind, column = r.getString("TYPE_NAME"), r.getString("COLUMN_NAME")
        exact = kind.upper() in ("DECIMAL", "NUMERIC", "NUMBER")
        columns.append(Column(column, kind, r.getString("IS_NULLABLE") != "NO", None if exact else size, size if exact else None, r.getInt("DECIMAL_DIGITS") if exact else None, r.getString("COLUMN_DEF"), column in keys))
    indexes: dict[str, dict] = {}
    for r in _rows(meta.getIndexInfo(None, schema, name, False, True)):
        if index := r.getString("INDEX_NAME"):
            entry = indexes.setdefault(index, {"name": index, "unique": not r.getBoolean("NON_UNIQUE"), "columns": []})
            entry["columns"].append(r.getString("COLUMN_NAME"))
    return Table(name, columns, keys, list(indexes.values()), schema)
