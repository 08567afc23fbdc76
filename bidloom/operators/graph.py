"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for the nodes of ``links`` (a, b).

    Each round gives every node the least root among its neighbours and then its root's root; a written table after
    each round keeps the plan short and survives lost executors.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    if both.isEmpty():
        return roots
    roots = cut(roots, "roots")
    for _ in range(most_rounds):
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        near = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = cut(near.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "roots")
        roots = after.select("node", "root")
        if not after.where("old <> root").limit(1).count():
            return roots
    raise RuntimeError("components did not settle")
