"""Versioned tables, increments and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.queries.registry import query, scratch, table
from millrace.runners import run
from millrace.runners.incremental import merge_changes
from millrace.tables.store import TableStore


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")


def _store(spark: SparkSession, sf_dir: str, name: str, condition: str = "true") -> TableStore:
    store = TableStore(spark, scratch(spark, name))
    store.write(_part(spark, sf_dir).filter(condition), "overwrite")
    return store


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part with a new size, and as many new parts."""
    some = _part(spark, sf_dir).filter("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100)
    return some.unionByName(some.withColumn("p_partkey", F.col("p_partkey") + 10_000_000))


_BOTH = """(SELECT p_partkey, p_name, p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END AS p_size FROM part
    UNION ALL SELECT p_partkey + 10000000, p_name, p_size + 100 FROM part WHERE p_partkey % 3 = 0)"""


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")
def tbl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "append")
    store.write(_part(spark, sf_dir).filter("p_size > 25"), "append")
    return store.read()


@query(f"SELECT * FROM {_BOTH}")
def tbl_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "merge")
    store.merge(_changes(spark, sf_dir), ["p_partkey"])
    return store.read()


@query(f"SELECT * FROM {_BOTH} WHERE NOT (p_partkey < 10000000 AND p_partkey % 6 = 0) AND NOT (p_partkey >= 10000000 AND p_size > 125)")
def tbl_merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "merge")
    store.merge(_changes(spark, sf_dir), ["p_partkey"], delete_condition="target.p_partkey % 6 = 0", insert_condition="source.p_size <= 125")
    return store.read()


@query(
    """SELECT p_partkey, p_name, p_size + CASE WHEN p_partkey % 3 = 0 AND p_size < 30 THEN 1 ELSE 0 END AS p_size FROM part
    UNION ALL SELECT p_partkey + 10000000, 'new ' || p_name, 0 FROM part WHERE p_partkey % 3 = 0"""
)
def tbl_merge_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "merge")
    values = {"p_partkey": "source.p_partkey", "p_name": "concat('new ', source.p_name)", "p_size": "0"}
    store.merge(_changes(spark, sf_dir), ["p_partkey"], update_condition="target.p_size < 30", update_set={"p_size": "target.p_size + 1"}, insert_values=values)
    return store.read()


@query(
    """SELECT p_partkey, p_name, p_size + CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 100 ELSE 0 END AS p_size, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS _is_deleted FROM part
    UNION ALL SELECT p_partkey + 10000000, p_name, p_size + 100, p_partkey % 2 = 0 FROM part WHERE p_partkey % 3 = 0"""
)
def tbl_merge_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "soft")
    ops = _changes(spark, sf_dir).withColumn("op", F.when(F.col("p_partkey") % 2 == 0, "D").otherwise("U"))
    merge_changes(store, ops, ["p_partkey"], "op", soft_delete=True)
    return store.read()


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 41 ELSE p_size END AS p_size FROM part")
def tbl_replace_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "replace")
    store.replace_where(_part(spark, sf_dir).filter("p_size > 40").withColumn("p_size", F.lit(41)), "p_size > 40")
    return store.read()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 20")
def tbl_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "travel", "p_size < 20")
    store.write(_part(spark, sf_dir), "append")
    store.delete_where("p_size < 10")
    return store.read(version=0)


@query("SELECT * FROM (VALUES (2, 'delete'), (1, 'append'), (0, 'overwrite')) t(version, operation)")
def tbl_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "history")
    store.write(_part(spark, sf_dir), "append")
    store.delete_where("p_size < 10")
    return store.history().select(F.col("version").cast("int").alias("version"), "operation")


@query("SELECT p_partkey, p_name, p_size FROM part")
def tbl_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "restore")
    store.delete_where("p_size < 40")
    store.restore(0)
    return store.read()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 30")
def tbl_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "optimize", "p_size < 20")
    store.write(_part(spark, sf_dir).filter("p_size >= 20 AND p_size < 30"), "append")
    store.optimize(["p_size", "p_name"])
    store.vacuum(0)
    return store.read()


@query("SELECT p_partkey, p_name, p_size FROM part")
def incremental_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: the second sees only what lies beyond the first."""
    root = scratch(spark, "inc")
    parts = _part(spark, sf_dir)
    middle = parts.agg(F.expr("CAST(max(p_partkey) / 2 AS BIGINT)")).first()[0]
    spec = {"pipeline_id": "inc", "mode": "incremental", "source": {"type": "file", "path": f"{root}/src"}, "target": {"type": "table", "path": f"{root}/out"}, "incremental": {"watermark_column": "p_partkey", "keys": ["p_partkey"]}}
    parts.filter(F.col("p_partkey") <= middle).write.parquet(f"{root}/src")
    run(spark, spec)
    parts.filter(F.col("p_partkey") > middle).write.mode("append").parquet(f"{root}/src")
    run(spark, spec)
    return TableStore(spark, f"{root}/out").read()


@query(f"SELECT * FROM {_BOTH} WHERE p_partkey % 2 <> 0 OR (p_partkey < 10000000 AND p_partkey % 3 <> 0)")
def cdc_hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose operation is D remove their rows; the others are upserts, a null one too."""
    store = _store(spark, sf_dir, "cdc")
    ops = _changes(spark, sf_dir).withColumn("op", F.when(F.col("p_partkey") % 2 == 0, "D").when(F.col("p_partkey") % 5 == 0, None).otherwise("U"))
    merge_changes(store, ops, ["p_partkey"], "op")
    return store.read()
