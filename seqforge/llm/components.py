"""Connected components by contraction, in a few rounds of aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each end of an edge (a, b long) the least node that it is connected to.

    Every round each node joins its least neighbour's least neighbour, and edges are carried over to
    what their ends have become; stars, such as those of hash buckets, are gone after one round and any
    graph after about the logarithm of its longest shortest path. Rounds are cut by written tables.
    Nothing but whether edges are left reaches the driver. Loops and repeated edges do no harm.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "found")
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("up")), "up")
        to = cut(up.join(up.select(F.col("x").alias("up"), F.col("up").alias("top")), "up").select("x", "top"), "to")
        older = (edges, found, up, to)
        found = cut(found.join(to, found.root == to.x, "left").select("node", F.coalesce("top", "root").alias("root")), "found")
        moved = edges.join(to.select(F.col("x").alias("a"), F.col("top").alias("ta")), "a").join(to.select(F.col("x").alias("b"), F.col("top").alias("tb")), "b")
        edges = cut(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(*older)
    discard(edges)
    return found
