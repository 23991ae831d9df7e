"""Data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import quality as ops
from millrace.operators.quality import Rule
from millrace.queries.registry import query, scratch, table


def _valid(df: DataFrame, *rules: Rule) -> DataFrame:
    return ops.split(df, rules)[0]


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a price that is null for small ones."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"))


_PRICED = "(SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS price FROM orders)"


@query(f"SELECT o_orderkey FROM {_PRICED} WHERE price IS NOT NULL")
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(_priced(spark, sf_dir), Rule("price", "price", "not_null")).select("o_orderkey")


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(_priced(spark, sf_dir), Rule("one", "o_custkey", "unique", {"order": ["o_orderkey"]})).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_PRICED} WHERE price >= 5000 AND price <= 150000")
def dq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(_priced(spark, sf_dir), Rule("range", "price", "range", {"min": 5000, "max": 150000})).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_PRICED} WHERE regexp_matches(o_orderpriority, '^[12]-')")
def dq_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(_priced(spark, sf_dir), Rule("urgent", "o_orderpriority", "pattern", {"pattern": "^[12]-"})).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def dq_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(table(spark, sf_dir, "customer"), Rule("segment", "c_mktsegment", "allowed_values", {"values": ["BUILDING", "MACHINERY"]})).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE length(p_name) >= 5 AND length(p_name) <= 12")
def dq_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(table(spark, sf_dir, "part"), Rule("name", "p_name", "length", {"min_length": 5, "max_length": 12})).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 100 < l_quantity")
def dq_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(table(spark, sf_dir, "lineitem"), Rule("rebate", None, "custom", {"check": "l_discount * 100 < l_quantity"})).select("l_orderkey", "l_linenumber")


def _rules() -> list[Rule]:
    return [
        Rule("has_price", "price", "not_null"),
        Rule("fair", "price", "range", {"min": 5000, "max": 150000}),
        Rule("urgent", "o_orderpriority", "regex", {"pattern": "^[1-3]-"}),
        Rule("known", "o_custkey", "custom", {"check": lambda c: c % 7 != 0}, severity="warning"),
    ]


_FAILED = f"""(SELECT *, concat_ws(',', CASE WHEN price IS NULL THEN 'has_price' END, CASE WHEN NOT coalesce(price >= 5000 AND price <= 150000, false) THEN 'fair' END,
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'urgent' END) AS failed FROM {_PRICED})"""


@query(f"SELECT o_orderkey, failed FROM {_FAILED}")
def dq_failed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = ops.evaluate(_priced(spark, sf_dir), _rules())
    return seen.select("o_orderkey", F.array_join(ops.FAILED, ",").alias("failed"))


@query(f"SELECT o_orderkey, failed FROM {_FAILED} WHERE failed <> ''")
def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "quarantine")
    ops.quarantine(ops.split(_priced(spark, sf_dir), _rules())[1], path)
    return spark.read.parquet(path).filter("_quarantine_timestamp IS NOT NULL").select("o_orderkey", F.array_join(ops.FAILED, ",").alias("failed"))


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (failed = '') AS valid, count(*) FILTER (failed <> '') AS invalid, round(count(*) FILTER (failed = '') * 100.0 / count(*), 6) AS score,
    count(*) FILTER (contains(failed, 'has_price')) AS failed_has_price, count(*) FILTER (contains(failed, 'fair')) AS failed_fair,
    count(*) FILTER (contains(failed, 'urgent')) AS failed_urgent, count(*) FILTER (o_custkey % 7 = 0) AS failed_known FROM {_FAILED}"""
)
def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.metrics(_priced(spark, sf_dir), _rules()).withColumn("score", F.round("score", 6))


@query(f"SELECT o_orderkey, round((3 - CASE WHEN failed = '' THEN 0 ELSE len(string_split(failed, ',')) END) / 3 * 100, 6) AS quality_score FROM {_FAILED}")
def dq_quality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_quality_columns(_priced(spark, sf_dir), _rules()).select("o_orderkey", F.round("quality_score", 6).alias("quality_score"))


@query(f"SELECT count(*) AS rows, count(*) FILTER (price IS NULL) AS nulls_price, count(*) - count(DISTINCT o_custkey) AS duplicates FROM {_PRICED}")
def dq_batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.check(_priced(spark, sf_dir), ["price"], ["o_custkey"])
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))
