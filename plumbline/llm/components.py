"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.session import written


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``links`` (src, dst).

    Every round sends each node to the smallest of itself and its neighbours and keeps only the links between
    different targets. The smallest node of a component stays, each other node moves towards it, and the links
    left shrink by at least half of the nodes, so the rounds grow with the logarithm of the longest path.
    Every round is written to the shared folder: lost executors recompute one round only, and the loop condition
    comes from the written table. Hot nodes are reduced map-side; nothing is collected.
    """
    pairs = links.filter(F.col("src") != F.col("dst")).select("src", "dst")
    found: DataFrame | None = None
    edges = written(pairs.distinct(), "component-links")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        step = written(
            both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
            .select("node", F.least("node", "near").alias("next")),
            "component-steps",
        )
        at_src = step.select(F.col("node").alias("src"), F.col("next").alias("a"))
        at_dst = step.select(F.col("node").alias("dst"), F.col("next").alias("b"))
        moved = edges.join(at_src, "src").join(at_dst, "dst")
        contracted = moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        edges = written(contracted.filter("src != dst").distinct(), "component-links")
        if found is None:
            found = step.withColumnRenamed("next", "root")
        else:
            ahead = step.select(F.col("node").alias("root"), "next")
            joined = found.join(ahead, "root", "left")
            found = written(joined.select("node", F.coalesce("next", "root").alias("root")), "component-roots")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return found
