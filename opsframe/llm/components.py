"""Connected components by label propagation with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.store import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Each round gives a node the least root among its neighbours' and its own, and then its root's root. A hub's edges
    meet in joins that Spark can split, and minima combine before their shuffle.
    """
    both = saved(edges.where("a <> b").select("a", "b").unionByName(
        edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(found.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = found.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        over = found.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = saved(stepped.join(over, "root", "left").select(
            "node", "was", F.least("root", F.coalesce("over", "root")).alias("root")), "roots")
        moved = not new.where("was <> root").isEmpty()
        found = new.select("node", "root")
        if not moved:
            return found
