"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.scratch import store


def _signature(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Large-star and small-star steps alternate until the links form stars. Each step is a group-by (which
    combines before it shuffles) and a join with its result, written to the shared folder, so a lost
    executor costs one step. The number of steps grows with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    state = store(pairs, "links")
    seen = _signature(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node link to the smallest node around it
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        # small star: a node and its neighbours below it link to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a <> b").distinct())
        state = store(small, "links")
        now = _signature(state)
        if now == seen:
            break
        seen = now
    heads = state.select(F.col("b").alias("node")).distinct()
    return (state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .unionByName(heads.select("node", F.col("node").alias("component"))))
