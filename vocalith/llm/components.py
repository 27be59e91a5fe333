"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the smallest v of their u, by partial sums and a join, whose hot keys Spark may split among tasks."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it is linked with, directly or not.

    Loops and repeated edges do no harm; without edges the result is empty. A hub's edges are never in one
    group: its smallest neighbour is found by partial aggregates and joined back.
    """
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of u go to the smallest node at hand
        large = _with_least(both).withColumn("m", F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: so do u and its smaller neighbours
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = save(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
