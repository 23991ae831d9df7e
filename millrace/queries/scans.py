"""Sources and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.project import apply_steps
from millrace.plans.pipeline import Pipeline
from millrace.queries.registry import query, scratch, table
from millrace.sinks import sink_for
from millrace.sources import read

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _file(spark: SparkSession, sf_dir: str, name: str) -> dict:
    return {"type": "file", "format": "parquet", "path": f"{sf_dir}/{name}.parquet"}


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, _file(spark, sf_dir, "orders")).filter("o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_totalprice")


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    path, df = scratch(spark, kind), table(spark, sf_dir, "customer")
    sink_for(spark, {"type": "file", "format": kind, "path": path, "mode": "overwrite"}).write(df)
    return read(spark, {"type": "file", "format": kind, "path": path, "schema": df.schema}).select(*df.columns)


@query(_CUSTOMER)
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query(_CUSTOMER)
def scan_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "json")


@query(_CUSTOMER)
def scan_orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "orc")


@query("SELECT r_name AS value FROM region")
def scan_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    sink_for(spark, {"type": "file", "format": "text", "path": path}).write(table(spark, sf_dir, "region").select(F.col("r_name").alias("value")))
    return read(spark, {"type": "file", "format": "text", "path": path})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5")
def scan_jdbc_derby(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = f"jdbc:derby:memory:scan{abs(hash(scratch(spark, 'derby')))};create=true"
    df = table(spark, sf_dir, "nation")
    sink = sink_for(spark, {"type": "jdbc", "url": url, "table": "NATION", "mode": "overwrite"})
    sink.write(df)
    found = read(spark, {"type": "jdbc", "url": url, "query": 'SELECT * FROM NATION WHERE "n_nationkey" >= 5'})
    return found.toDF(*df.columns)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def filter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_steps(table(spark, sf_dir, "lineitem"), [{"type": "filter", "condition": "l_quantity > 25 AND l_discount < 0.05"}, {"type": "select", "columns": ["l_orderkey", "l_linenumber", "l_quantity"]}])


@query("SELECT c_custkey, c_name, round(c_acctbal * 2, 2) AS doubled FROM customer")
def select_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_steps(table(spark, sf_dir, "customer"), [{"type": "select", "columns": ["c_custkey", "c_name", "round(c_acctbal * 2, 2) AS doubled"]}])


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def rename_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"type": "select", "columns": ["p_partkey", "p_name", "p_size"]}, {"type": "rename", "mapping": {"p_partkey": "id", "p_name": "name", "p_size": "size"}}]
    return apply_steps(table(spark, sf_dir, "part"), steps)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS INTEGER) AS p_name FROM part")
def cast_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"type": "select", "columns": ["p_partkey", "p_size", "p_name"]}, {"type": "cast", "mapping": {"p_partkey": "string", "p_size": "bigint", "p_name": "int"}}]
    return apply_steps(table(spark, sf_dir, "part"), steps)


@query(
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND regexp_matches(o_orderpriority, '^[1-3]') AND o_totalprice >= 500 AND o_totalprice <= 200000 AND o_custkey IS NOT NULL"""
)
def predicates_isin_rlike_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keep = c("o_orderstatus").isin("F", "O") & c("o_orderpriority").rlike("^[1-3]") & (c("o_totalprice") >= 500) & (c("o_totalprice") <= 200000) & c("o_custkey").isNotNull()
    return table(spark, sf_dir, "orders").filter(keep).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT r_regionkey, r_name, CAST(NULL AS INTEGER) AS note, 'x' AS tag FROM region")
def add_literal_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").withColumns({"note": F.lit(None).cast("int"), "tag": F.lit("x")})


@query(
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, count(l_orderkey) AS l_orderkey_count
    FROM lineitem WHERE l_quantity > 10 GROUP BY 1"""
)
def pipeline_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chained pipeline: scan, filter, aggregate, versioned table; read back."""
    path = scratch(spark, "built")
    pipeline = Pipeline(spark).add_source(_file(spark, sf_dir, "lineitem"))
    pipeline.add_transformer({"type": "filter", "condition": "l_quantity > 10"})
    metrics = [{"type": "sum", "column": "l_extendedprice", "alias": "l_extendedprice_sum"}, {"type": "count", "column": "l_orderkey", "alias": "l_orderkey_count"}]
    pipeline.add_transformer({"type": "aggregate", "group_by": ["l_returnflag"], "metrics": metrics}, lambda df: df.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2)))
    pipeline.add_sink({"type": "table", "path": path, "mode": "overwrite"}).run()
    return read(spark, {"type": "table", "path": path})


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def order_limit_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return apply_steps(counted, [{"type": "repartition", "columns": ["l_returnflag"]}, {"type": "order", "columns": ["l_returnflag"]}, {"type": "limit", "n": 100}])
