"""Connected components of a table of links, by alternating stars, all on the executors.

Each round hangs every node's larger neighbours on the smallest node it knows (large star), then
every node's smaller neighbours likewise (small star). The number of rounds grows with the logarithm
of the longest chain; what a round leaves is staged, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import HOT_ROWS, join_one, stage


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (a long, b long); root is the smallest node it reaches.

    Self links and repeats do not matter; rows with a null do not link. No links, no rows."""
    pairs = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        pairs = stage(pairs, "links")
        state = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state[0] == 0 or state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        before = state
        hung = _large_star(pairs)
        pairs = _small_star(stage(hung, "hung") if state[0] > HOT_ROWS else hung, state[0])


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_one(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame, rows: int) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = join_one(pairs, least, "u") if rows > HOT_ROWS else pairs.join(least, "u")
    hung = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()
