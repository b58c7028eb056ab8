"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, lookup_join


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None, rows: int | None = None) -> DataFrame:
    """node, component (the smallest node that it reaches) of every node of an edge between two different nodes.

    Each round points every node at that neighbour, or itself, whose hash is smallest, and contracts the
    graph; hashes instead of ids keep the expected number of rounds logarithmic on long
    chains. Nodes and edges stay in tables in the shared folder, of which only the result is left at the end;
    it can be dropped from scratch. rows: as many as edges may have, where that is known. Null ends and loops are left out. An empty table gives an empty one.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = scratch.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", rows)
    n = edges.count()
    where = scratch.stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes", 2 * n)
    total = where.count()
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"), F.count(F.lit(1)).alias("degree"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        step = ranked.select(F.col("a").alias("node"), F.least("m", own)["id"].alias("to"), "degree")
        # A root may stand for a third of all nodes, and a node of a star has as many edges; both joins deal such keys out.
        weight = where.groupBy("root").agg(F.count(F.lit(1)).alias("weight")).withColumnRenamed("root", "node")
        step = scratch.stored(step.join(weight, "node"), "steps", 2 * n)
        moved = lookup_join(edges, step.select(F.col("node").alias("a"), F.col("to").alias("ta"), "degree"), ["a"], "degree", n, ["b"]).drop("degree")
        moved = lookup_join(moved, step.select(F.col("node").alias("b"), F.col("to").alias("tb"), "degree"), ["b"], "degree", n, ["a"]).where("ta <> tb")
        fewer = scratch.stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges", n)
        there = lookup_join(where, step.select(F.col("node").alias("root"), "to", "weight"), ["root"], "weight", total, ["node"])
        there = scratch.stored(there.select("node", F.coalesce("to", "root").alias("root")), "nodes", total)
        scratch.drop(edges, step, where)
        edges, where, n = fewer, there, fewer.count()
    least = where.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("weight"))
    out = scratch.stored(lookup_join(where, least, ["root"], "weight", total, ["node"]).select("node", "component"), "components", total)
    scratch.drop(edges, where)
    return out
