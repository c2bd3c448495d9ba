"""Connected components of a graph given by its edges, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


#: Edges in a file, about.
EDGES = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def roots(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that can be reached) of every node of `edges` (a, b: long) with a root other than itself.

    Alternates large stars and small stars until no edge changes; the number of rounds grows with the logarithm of the
    longest chain. Minima are taken with partial aggregation, and the joins back to the edges are sort-merge joins whose
    hot nodes AQE splits. Each round is written, so a lost executor costs one round at most. Null ends and loops are no edges.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        ways = _both_ways(now)
        lowest = ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = ways.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.distinct().coalesce(max(1, -(-mark[0] // EDGES))))
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
