"""Window functions, duplicates and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup, window
from millrace.queries.registry import query, table


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS o_totalprice_sum_window, count(o_orderkey) OVER (PARTITION BY o_custkey) AS o_orderkey_count_window FROM orders")
def win_partition_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = window.window_aggregates(table(spark, sf_dir, "orders"), ["o_custkey"], {"sum": ["o_totalprice"], "count": ["o_orderkey"]})
    return made.select("o_orderkey", F.round("o_totalprice_sum_window", 2).alias("o_totalprice_sum_window"), "o_orderkey_count_window")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS o_totalprice_sum_window FROM orders")
def win_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = window.window_aggregates(table(spark, sf_dir, "orders"), ["o_custkey"], {"sum": ["o_totalprice"]}, ["o_orderdate", "o_orderkey"])
    return made.select("o_orderkey", F.round("o_totalprice_sum_window", 2).alias("o_totalprice_sum_window"))


@query(
    """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS row_number, CAST(rank() OVER v AS INTEGER) AS rank, CAST(dense_rank() OVER v AS INTEGER) AS dense_rank,
    round(percent_rank() OVER v, 9) AS percent_rank, round(cume_dist() OVER v, 9) AS cume_dist
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"""
)
def win_rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = window.ranks(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["row_number"])
    made = window.ranks(made, ["o_orderstatus"], ["o_orderpriority"], ["rank", "dense_rank", "percent_rank", "cume_dist"])
    return made.select("o_orderkey", "row_number", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


@query("SELECT event_id, lag(value) OVER w AS value_lag, lead(value) OVER w AS value_lead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value_lag", "value_lead")


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS ntile FROM customer")
def win_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.ranks(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_acctbal", "c_custkey"], [], 4).select("c_custkey", "ntile")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS value_avg_window FROM events")
def win_rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = window.window_aggregates(table(spark, sf_dir, "events"), ["user_id"], {"avg": ["value"]}, ["ts", "event_id"], rows=(-2, 0))
    return made.select("event_id", F.round("value_avg_window", 4).alias("value_avg_window"))


@query("SELECT c_custkey, count(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c_custkey_count_window FROM customer")
def win_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.window_aggregates(table(spark, sf_dir, "customer"), ["c_mktsegment"], {"count": ["c_custkey"]}, ["c_nationkey"], range_=(-2, 2)).select("c_custkey", "c_custkey_count_window")


@query(
    """SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o_orderkey_nth2
    FROM (SELECT *, o_orderkey AS k FROM orders)"""
)
def win_nth_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.nth_values(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", [2]).select("o_orderkey", "o_orderkey_nth2")


@query("SELECT DISTINCT event_type, user_id FROM events")
def dedup_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "events").select("event_type", "user_id"))


_RANKED = "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {}) AS r FROM orders) WHERE r = 1"


@query(_RANKED.format("o_orderkey"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "orders"), ["o_custkey"], "first", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(_RANKED.format("o_orderkey DESC"))
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "orders"), ["o_custkey"], "last", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(_RANKED.format("o_orderdate DESC NULLS LAST, o_orderkey"))
def dedup_latest_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "orders"), ["o_custkey"], "latest_timestamp", timestamp="o_orderdate", ties=["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY 1")
def dedup_without_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "orders"), ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.top_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_mktsegment", "c_custkey")
