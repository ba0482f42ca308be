"""Connected components of a large edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reached.

    Every step is a shuffle with map-side combine over at most as many edges as there were; the number of steps grows with the logarithm of
    the longest chain. Each step's edges are written to the shared folder, so lineage stays short. The only thing that reaches the driver
    is a count and a sum.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    mark = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(size) or not size[0]:
            break
        mark = tuple(size)
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("m", "v").alias("m"))
        large = both.join(least, both.v == least.c).filter(F.col("u") > F.col("c")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: every smaller neighbour of a node, and the node, goes to its smallest neighbour
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = large.join(smallest, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e"))
        following = stored(pairs.select("e.v", "e.u").filter("u < v").distinct())
        forget(now)
        now = following
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
