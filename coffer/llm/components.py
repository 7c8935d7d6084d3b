"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges(a, b)``.

    Each round hangs every node under its smallest neighbour, flattens the
    trees by pointer jumping and contracts them, so rounds and jumps both are
    logarithmic. All groupings aggregate before the shuffle; what a round
    leaves is written to the shared folder.
    """
    edges = saved(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    found = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "cc-parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            nxt = saved(parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc-jump")
            parent = nxt.select("a", "p")
            if not nxt.filter("moved").head(1):
                break
        if found is None:
            found = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            found = found.join(parent.withColumnRenamed("a", "component"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            )
        pa, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = saved(
            edges.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct(),
            "cc-edges",
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return saved(found, "cc-found")
