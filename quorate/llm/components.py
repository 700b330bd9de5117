"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, label): for each node of an edge the smallest node it is connected with.

    Large-star and small-star turns, each written to the shared folder, until nothing changes: the
    rounds grow with the logarithm of the longest path. Loops and repeated edges are allowed."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        large = (
            both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        )
        large = settle(large, "large-star")
        # Small star: u and its smaller neighbours go to the least of these.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = settle(small, "small-least")
        moved = large.join(small.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        edges = settle(moved.distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
