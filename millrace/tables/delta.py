"""Delta tables, where the session has the Delta jar. Without it `delta` means a TableStore."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def available(spark: SparkSession) -> bool:
    try:
        spark._jvm.org.apache.spark.util.Utils.classForName("io.delta.tables.DeltaTable", False, False)
    except Exception:
        return False
    return True


def read(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """path; version, which counts before timestamp."""
    reader = spark.read.format("delta").options(**spec.get("options", {}))
    if spec.get("version") is not None:
        reader = reader.option("versionAsOf", spec["version"])
    elif spec.get("timestamp") is not None:
        reader = reader.option("timestampAsOf", str(spec["timestamp"]))
    return reader.load(spec["path"])


def merge_sql(path: str, source: str, columns: Sequence[str], keys: Sequence[str], spec: Mapping[str, Any]) -> str:
    """MERGE INTO with the clauses of a spec: a deletion first, then updates, then insertions."""
    on = " AND ".join(f"target.`{k}` = source.`{k}`" for k in keys) or "FALSE"
    when = lambda condition: f" AND ({condition})" if condition else ""
    out = f"MERGE INTO delta.`{path}` AS target USING {source} AS source ON {on}"
    if spec.get("delete_condition"):
        out += f" WHEN MATCHED{when(spec['delete_condition'])} THEN DELETE"
    sets = spec.get("update_set")
    assigned = ", ".join(f"target.`{c}` = {e}" for c, e in sets.items()) if sets else ", ".join(f"target.`{c}` = source.`{c}`" for c in columns)
    out += f" WHEN MATCHED{when(spec.get('update_condition'))} THEN UPDATE SET {assigned}"
    values = spec.get("insert_values") or {c: f"source.`{c}`" for c in columns}
    return out + f" WHEN NOT MATCHED{when(spec.get('insert_condition'))} THEN INSERT ({', '.join(f'`{c}`' for c in values)}) VALUES ({', '.join(values.values())})"


def write(df: DataFrame, path: str, mode: str, partition_by: Sequence[str] = (), merge_schema: bool = False, keys: Sequence[str] = (), spec: Mapping[str, Any] = {}, options: Mapping[str, Any] | None = None) -> None:
    spark = df.sparkSession
    exists = spark._jvm.io.delta.tables.DeltaTable.isDeltaTable(spark._jsparkSession, path)
    if mode == "merge" and exists:
        df.createOrReplaceTempView("millrace_changes")
        spark.sql(merge_sql(path, "millrace_changes", df.columns, keys, spec))
        return
    writer = df.write.format("delta").mode("overwrite" if mode == "merge" else mode).options(**(options or {}))
    if merge_schema:
        writer = writer.option("mergeSchema", "true")
    if spec.get("replace_where"):
        writer = writer.mode("overwrite").option("replaceWhere", spec["replace_where"])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def maintain(spark: SparkSession, path: str, z_order: Sequence[str] = (), vacuum_hours: float | None = None, restore: int | None = None) -> None:
    """Restores a version, compacts and vacuums, in this order."""
    if restore is not None:
        spark.sql(f"RESTORE TABLE delta.`{path}` TO VERSION AS OF {int(restore)}")
    spark.sql(f"OPTIMIZE delta.`{path}`" + (f" ZORDER BY ({', '.join(z_order)})" if z_order else ""))
    if vacuum_hours is not None:
        spark.sql(f"VACUUM delta.`{path}` RETAIN {vacuum_hours} HOURS")


def history(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    return spark.sql(f"DESCRIBE HISTORY delta.`{path}` LIMIT {int(limit)}")
