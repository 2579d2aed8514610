"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Every step is one shuffle of the edge list and reduces long chains by a constant factor; the edge list is written to the shared
folder after each round, so that no lineage grows and lost executors do no harm. No component is gathered in one task: a node of
very many edges meets only a minimum, taken with partial aggregation, and a join that adaptive execution splits.

An empty edge list gives an empty result, self edges and repeated edges make no difference, edges with a null end are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import discarded, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node in it) of each node that has an edge."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = written(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, is tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "components")
        discarded(e)
        e = after
        # Done when all that is left are stars: every node with an edge to a smaller one has just that one, and none to a larger.
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("node").agg(F.sum("down").alias("d"), F.sum("up").alias("u")).where("d > 1 or (d > 0 and u > 0)").isEmpty():
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
