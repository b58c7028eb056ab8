"""Connected components in Spark, for grids of cells and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every end of edges (a, b).

    In each round every node joins that neighbour, or stays, whose hash is least, and the graph shrinks to those joined; hashes keep long chains to
    logarithmically many rounds. Both tables are computed once a round.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", ranked("a"))["id"].alias("to")))
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = cut(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        nodes = cut(nodes.join(to("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")))
    least = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(least, "root").select("node", "component")
