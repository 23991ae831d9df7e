"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins as ops
from millrace.operators import sets
from millrace.queries.registry import query, table


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name", "n_regionkey")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.equi_join(_customers(spark, sf_dir), _nations(spark, sf_dir), ["key"]).select("c_custkey", "n_name")


@query(
    """SELECT c_custkey, count(o_orderkey) AS total_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total_spent
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
)
def join_left_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s"))
    found = ops.equi_join(table(spark, sf_dir, "customer").select("c_custkey"), sums, ["c_custkey"], "left")
    return found.select("c_custkey", F.coalesce("n", F.lit(0)).alias("total_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total_spent"))


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    return ops.equi_join(suppliers, _nations(spark, sf_dir), ["key"], "right").select("s_suppkey", "n_name")


@query(
    """SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k"""
)
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return ops.equi_join(a, b, ["k"], "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return ops.equi_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return ops.equi_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], "left_anti")


@query("SELECT a.r_name AS left_region, b.r_name AS right_region FROM region a CROSS JOIN region b")
def join_cross_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("left_region")).crossJoin(r.select(F.col("r_name").alias("right_region")))


@query(
    """SELECT o_orderkey, band FROM orders JOIN (VALUES (0, 0.0, 1000.0), (1, 1000.0, 50000.0), (2, 50000.0, 250000.0)) b(band, low, high)
    ON o_totalprice >= low AND o_totalprice <= high"""
)
def join_theta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 0.0, 1000.0), (1, 1000.0, 50000.0), (2, 50000.0, 250000.0)], "band int, low double, high double")
    return ops.range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "low", "high", 10_000.0).select("o_orderkey", "band")


@query(
    """SELECT o_orderkey, (SELECT max(struct_pack(t := ts, e := event_id)).e FROM events WHERE user_id = o_custkey AND ts <= o_orderdate + INTERVAL 30 YEAR) AS asof_event_id FROM orders"""
)
def join_asof_orders_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 YEAR")).alias("at"))
    return ops.asof_join(orders, table(spark, sf_dir, "events"), "user_id", "at", "ts", ["event_id"], every=86_400.0).select("o_orderkey", "asof_event_id")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return ops.equi_join(table(spark, sf_dir, "lineitem"), ops.broadcast_if_small(parts), ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query(
    """SELECT k, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 3) AS j FROM supplier) b ON k IS NOT DISTINCT FROM j
    GROUP BY 1"""
)
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 3 is made null on both sides, and its customers meet its suppliers all the same."""
    nation = lambda name, key: table(spark, sf_dir, name).select(F.expr(f"nullif({key}, 3)").alias("k"))
    return ops.equi_join(nation("customer", "c_nationkey"), nation("supplier", "s_nationkey"), ["k"], null_safe=True).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_SETS = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 {} SELECT s_nationkey AS k FROM supplier"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


@query(_SETS.format("UNION ALL"))
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_all(*_sides(spark, sf_dir))


@query(_SETS.format("UNION"))
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_distinct(*_sides(spark, sf_dir))


@query(_SETS.format("INTERSECT"))
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersect(*_sides(spark, sf_dir))


@query(_SETS.format("INTERSECT ALL"))
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersect(*_sides(spark, sf_dir), all_=True)


@query(_SETS.format("EXCEPT"))
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_sides(spark, sf_dir))


@query(_SETS.format("EXCEPT ALL"))
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_sides(spark, sf_dir), all_=True)
