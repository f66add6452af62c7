"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.plans.workspace import Workspace


def _toward_least(links: DataFrame, only_larger: bool) -> DataFrame:
    """One star step: the neighbours of each node are linked to the least of them and the node.

    Only neighbours larger than the node move (large star), or only the smaller ones and the node (small star).
    """
    if only_larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        moved = both.where("b > a").join(around, "a").select(F.col("least").alias("a"), "b")
    else:
        down = links.select(F.col("b").alias("n"), F.col("a").alias("v"))
        around = down.groupBy("n").agg(F.min("v").alias("least"))
        moved = (down.join(around, "n").select(F.col("least").alias("a"), F.col("v").alias("b"))
                 .unionByName(around.select(F.col("least").alias("a"), F.col("n").alias("b"))))
    return moved.where("a < b").distinct()


def connected_components(ws: Workspace, links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links`` (a, b: bigint).

    Large and small stars in turn, until every link goes to the least node of its component. Each step is a written
    table; a hub is never collected, its neighbours only join its minimum. Null ends and links of a node to itself
    are left out; repeated links count once.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = ws.save(links.where("a is not null and b is not null and a <> b")
                  .select(least.alias("a"), most.alias("b")).distinct(), "links")
    while True:
        after = ws.save(_toward_least(ws.save(_toward_least(now, True), "large"), False), "small")
        # Done when all links are stars: no node has two larger ends or is both an end and a root.
        deeper = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        twice = after.groupBy("b").count().where("count > 1")
        now = after
        if deeper.isEmpty() and twice.isEmpty():
            break
    roots = now.select("a").distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
