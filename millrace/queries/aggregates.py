"""Aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregate as ops
from millrace.queries.registry import query, table


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY 1, 2"""
)
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"),
    )


@query(
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_avg, count(l_quantity) AS l_quantity_count,
    min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY 1"""
)
def agg_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"sum": ["l_quantity"], "avg": ["l_quantity"], "count": ["l_quantity"], "min": ["l_extendedprice"], "max": ["l_extendedprice"]})
    return _rounded(_rounded(made, 2, "l_quantity_sum"), 4, "l_quantity_avg")


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS l_quantity_stddev, round(var_samp(l_quantity), 6) AS l_quantity_variance FROM lineitem GROUP BY 1")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"stddev": ["l_quantity"], "variance": ["l_quantity"]})
    return _rounded(made, 6, "l_quantity_stddev", "l_quantity_variance")


@query(
    """SELECT user_id, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS event_type_first, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type_last
    FROM events GROUP BY 1"""
)
def agg_min_by_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.aggregate(table(spark, sf_dir, "events"), ["user_id"], {"first": ["event_type"], "last": ["event_type"]}, order=["ts", "event_id"])


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS order_keys FROM orders GROUP BY 1")
def agg_collect_list_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], {"collect_list": ["o_orderkey"]})
    return made.select("o_custkey", F.array_join(F.col("o_orderkey_collect_list").cast("array<string>"), ",").alias("order_keys"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1")
def agg_collect_set_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.aggregate(table(spark, sf_dir, "events"), ["user_id"], {"collect_set": ["event_type"]})
    return made.select("user_id", F.array_join("event_type_collect_set", ",").alias("types"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS l_partkey_count_distinct, count(DISTINCT l_suppkey) AS l_suppkey_count_distinct FROM lineitem GROUP BY 1")
def agg_count_distinct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"count_distinct": ["l_partkey", "l_suppkey"]})


@query()
def agg_approx_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"approx_count_distinct": ["l_partkey"]})


@query(
    """SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 2) AS click, round(sum(value) FILTER (event_type = 'purchase'), 2) AS purchase,
    round(sum(value) FILTER (event_type = 'view'), 2) AS view FROM events GROUP BY 1"""
)
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "purchase", "view"]
    return _rounded(ops.pivot(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "sum", kinds), 2, *kinds)


@query("SELECT s_suppkey, 'nation' AS variable, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def agg_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return ops.unpivot(wide, ["s_suppkey"], ["nation", "balance"])


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.rollup(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"sum": ["l_quantity"]}, True), 2, "l_quantity_sum")


@query(
    """SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS o_orderkey_count, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS grouping_id
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cube(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"count": ["o_orderkey"]}, True)


@query("SELECT c_nationkey, c_mktsegment, count(c_custkey) AS c_custkey_count FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grouping_sets(table(spark, sf_dir, "customer"), [["c_nationkey"], ["c_mktsegment"], []], {"count": ["c_custkey"]})


@query("SELECT event_type, quantile_disc(value, 0.5) AS value_p50, quantile_disc(value, 0.9) AS value_p90 FROM events GROUP BY 1")
def agg_percentile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.29), 6) AS l_extendedprice_p29, round(quantile_cont(l_extendedprice, 0.99), 6) AS l_extendedprice_p99 FROM lineitem GROUP BY 1")
def agg_percentile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.29, 0.99], exact=True)
    return _rounded(made, 6, "l_extendedprice_p29", "l_extendedprice_p99")


@query("SELECT count(o_orderkey) AS o_orderkey_count, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.aggregate(table(spark, sf_dir, "orders"), [], {"count": ["o_orderkey"], "sum": ["o_totalprice"]}), 2, "o_totalprice_sum")


@query("SELECT count(*) FILTER (o_custkey IS NULL) AS o_custkey_nulls, count(*) FILTER (cancelled IS NULL) AS cancelled_nulls FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 END AS cancelled FROM orders)")
def agg_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.null_counts(table(spark, sf_dir, "orders").withColumn("cancelled", F.when(F.col("o_orderstatus") == "F", 1)), ["o_custkey", "cancelled"])


@query("SELECT count(*) AS total, count(DISTINCT o_custkey) AS distinct_keys, count(*) - count(DISTINCT o_custkey) AS duplicates FROM orders")
def agg_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_count(table(spark, sf_dir, "orders"), ["o_custkey"])


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1, 2"""
)
def agg_named_metrics_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = [{"type": "count", "column": "*", "alias": "n"}, {"type": "sum", "column": "value", "alias": "total"}]
    made = ops.named_metrics(table(spark, sf_dir, "events"), ["event_type"], metrics, {"column": "ts", "duration": "1 hour"})
    return made.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
