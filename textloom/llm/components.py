"""Connected components of an edge table, by contraction in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import staged


def rooted(both: DataFrame) -> DataFrame:
    """(node, root): each node hangs under its least neighbour, the lesser of two that choose each other is a root.

    A node's choice of choice is at most the node, so there are no cycles but those of two.
    Pointers are doubled until all end at roots, so rounds grow with the logarithm of the depth.
    """
    least = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "least")
    back = least.select(F.col("node").alias("other"), F.col("up").alias("back"))
    own = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
    up = staged(least.join(back, F.col("up") == F.col("other")).select("node", F.when(own, F.col("node")).otherwise(F.col("up")).alias("up")), "up")
    while True:
        above = up.select(F.col("node").alias("other"), F.col("up").alias("above"))
        new = staged(up.join(above, F.col("up") == F.col("other")).select("node", F.col("up").alias("was"), F.col("above").alias("up")), "up")
        up = new.select("node", "up")
        if not new.filter("was <> up").limit(1).count():
            return up.withColumnRenamed("up", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node of each node's component, for edges (a, b) of bigints.

    Each round joins every node that has an edge with another and keeps the edges between
    the joined, so at most half of the nodes are left and rounds are at most log2 of them.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    maps = [rooted(both)]
    while True:
        a, b = (maps[-1].select(F.col("node").alias(f"node_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
        ends = both.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
        both = staged(ends.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
        if not both.limit(1).count():
            break
        maps.append(rooted(both))
    out = maps.pop()
    while maps:
        top = out.select(F.col("node").alias("other"), F.col("root").alias("top"))
        out = staged(maps.pop().join(top, F.col("root") == F.col("other"), "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    least = out.groupBy("root").agg(F.min("node").alias("class"))
    return staged(out.join(least, "root").select("node", "class"), "labels")
