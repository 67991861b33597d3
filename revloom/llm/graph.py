"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revloom.session import pin


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``edges (a, b)``; the root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows that hook once more and
    contracts the edges, so at least half of the nodes with an edge left go. Rounds are written to
    the shared checkpoint folder; nothing but row counts reaches the driver. Loops, repeated edges
    and either direction are fine; edges with a null end are left out; no edges give no rows.
    """
    edges = pin(edges.select("a", "b").na.drop().where("a <> b").distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = pin(ends.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        next_hook = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = pin(hook.join(next_hook, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        labels = pin(
            labels.join(hook.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        )
        moved = edges.join(hook, "a").select(F.col("p").alias("a"), "b")
        moved = moved.join(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").select("a", F.col("pb").alias("b"))
        edges = pin(moved.where("a <> b").distinct())
    return labels
