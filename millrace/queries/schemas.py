"""Schemas, casts and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import kafka_columns, parse_json_columns, parse_timestamp, snake_case_column
from millrace.operators import casting, schema
from millrace.queries.registry import query, table


@query("SELECT * FROM nation")
def schema_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.validate(table(spark, sf_dir, "nation"), table(spark, sf_dir, "nation").schema, "strict", required=["n_nationkey", "n_name"])


@query("SELECT * FROM region")
def schema_add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.validate(table(spark, sf_dir, "region"), T.StructType([T.StructField("r_name", T.StringType())]), "add_columns")


@query("SELECT TRY_CAST(s_name AS INTEGER) AS s_name, CAST(NULL AS DOUBLE) AS rating, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_nationkey, s_acctbal FROM supplier")
def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = T.StructType([T.StructField("s_name", T.IntegerType()), T.StructField("rating", T.DoubleType()), T.StructField("s_suppkey", T.StringType())])
    return schema.validate(table(spark, sf_dir, "supplier"), expected, "evolve")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.lit("n/a")).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.lit(None))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("text"))


_TEXTS = "(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS text FROM orders)"


@query(f"SELECT o_orderkey, TRY_CAST(text AS DOUBLE) AS text FROM {_TEXTS}")
def cast_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.cast(_texts(spark, sf_dir), {"text": "double", "absent": "int"})


@query(f"SELECT count(TRY_CAST(text AS DOUBLE)) AS text_converted, count(text) - count(TRY_CAST(text AS DOUBLE)) AS text_failed FROM {_TEXTS}")
def cast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.conversions(_texts(spark, sf_dir), {"text": "double"})


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') END AS parsed FROM orders"""
)
def parse_date_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(parse_timestamp(text), "yyyy-MM-dd").alias("parsed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("props").alias("value"), F.col("event_id").alias("offset"))
    return parse_json_columns(events, "k int", keep=["offset"]).select(F.col("kafka_offset").alias("event_id"), "k")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS value FROM nation")
def json_to_kafka_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kafka_columns(table(spark, sf_dir, "nation"))


@query(
    """SELECT c_custkey, lower(array_to_string(list_transform(range(1, length(name) + 1), lambda k: CASE
    WHEN k > 1 AND name[k] BETWEEN 'A' AND 'Z' AND (name[k - 1] BETWEEN 'a' AND 'z' OR name[k - 1] BETWEEN '0' AND '9' OR (k < length(name) AND name[k + 1] BETWEEN 'a' AND 'z'))
    THEN '_' || name[k] ELSE name[k] END), '')) AS name
    FROM (SELECT c_custkey, replace(c_name, '#', 'HTTPCode') || 'EndOf' AS name FROM customer)"""
)
def snake_case_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("HTTPCode")), F.lit("EndOf"))
    return table(spark, sf_dir, "customer").select("c_custkey", snake_case_column(name).alias("name"))
