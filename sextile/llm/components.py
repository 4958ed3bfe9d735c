"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """`node` and `root`, its smallest reachable node, for every node of the links (u, v).

    Each round points every node to its smallest neighbour, follows the pointers twice, and keeps
    the links between unlike targets only; the rest of a star or chain is gone after a few rounds.
    Every round is written to the shared folder, and nothing but a count reaches the driver.
    """
    edges = scratch.table(links.select("u", "v").where("u <> v"), "links")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    roots = scratch.table(nodes.select("node", F.col("node").alias("root")), "roots")
    while edges.take(1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v"))
        hook = scratch.table(low.select("u", F.least("u", "v").alias("to")), "hook")
        for _ in range(2):
            step = hook.select(F.col("u").alias("to"), F.col("to").alias("far"))
            hook = hook.join(step, "to").select("u", F.col("far").alias("to"))
        hook = scratch.table(hook, "jumped")
        roots = scratch.table(
            roots.join(hook.withColumnRenamed("u", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "roots",
        )
        edges = scratch.table(
            edges.join(hook, "u")
            .select(F.col("to").alias("a"), F.col("v").alias("u"))
            .join(hook, "u")
            .select(F.least("a", "to").alias("u"), F.greatest("a", "to").alias("v"))
            .where("u <> v")
            .distinct(),
            "links",
        )
    return roots
