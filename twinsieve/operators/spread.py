"""Largest pairwise distance inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import hamming, min_frame_distance
from twinsieve.plans.skew import SizedKeys
from twinsieve.plans.workspace import Workspace

#: Stars up to this size are compared directly.
SMALL_STAR = 64
#: Nodes of one larger star that one task compares with as many others.
TILE_NODES = 4_000


def small_spread(stars: DataFrame, distance: Column) -> DataFrame:
    """``(owner, max_distance)`` of stars of two to SMALL_STAR nodes.

    Stars have ``(owner, rk, x)``; ``distance`` compares ``x`` with ``y``.
    """
    sizes = stars.groupBy("owner").agg(F.count(F.lit(1)).alias("nodes"))
    few = stars.join(sizes.where(F.col("nodes").between(2, SMALL_STAR)).select("owner"), "owner", "left_semi")
    other = few.select("owner", F.col("rk").alias("other_rk"), F.col("x").alias("y"))
    return (few.join(other, "owner").where("rk < other_rk")
            .groupBy("owner").agg(F.max(distance).alias("max_distance")))


def star_spread(ws: Workspace, stars: DataFrame) -> DataFrame:
    """``(owner, max_distance)`` of large groups ``(owner, rk, x, nodes)`` of fingerprints ``x``.

    ``nodes`` is the size of the group. The distance is a metric, so two passes
    from far-out nodes find a large distance and the triangle inequality
    leaves only the nodes that could take part in a larger one. Those, mostly
    none, are compared with each other.
    """
    # All of a star lies around its seed; any node will do for other groups.
    seed = F.max(F.when(F.col("rk") == F.col("owner"), F.col("x")))
    sizes = stars.groupBy("owner").agg(F.coalesce(seed, F.min("x")).alias("origin"),
                                       F.first("nodes").alias("nodes"))
    members = ws.save(SizedKeys(ws, sizes, ["owner"], "nodes", "origins").join(stars.drop("nodes"))
                      .select("owner", "rk", "x", "nodes", hamming("x", "origin").alias("d0")), "radial")
    # Farthest from the origin, then farthest from that.
    far = SizedKeys(ws, members.groupBy("owner").agg(
        F.max("d0").alias("r0"), F.max_by("x", "d0").alias("far"), F.first("nodes").alias("nodes")),
        ["owner"], "nodes", "far")
    members = far.join(members.drop("nodes")).withColumn("d1", hamming("x", "far"))
    found = SizedKeys(ws, members.groupBy("owner").agg(
        F.max("d1").alias("r1"), F.first("nodes").alias("nodes")), ["owner"], "nodes", "found")
    open_nodes = (found.join(members.drop("nodes")).where("d0 + r0 > r1")
                  .select("owner", "rk", "x", "d0", "r1"))
    rest = _compare(ws, open_nodes, hamming("x", "y"), F.col("d0") + F.col("other_d0") > F.col("r1"))
    return (found.df.join(rest, "owner", "left")
            .select("owner", F.greatest("r1", "max_distance").alias("max_distance")))


def frame_star_spread(ws: Workspace, stars: DataFrame) -> DataFrame:
    """As ``star_spread`` for arrays of frames ``x``; the distance is the smallest over frames.

    That is no metric, so nothing can be left out.
    """
    return _compare(ws, stars.select("owner", "rk", "x"), min_frame_distance("x", "y"), F.lit(True))


def _compare(ws: Workspace, nodes: DataFrame, distance: Column, worth: Column) -> DataFrame:
    """``(owner, max_distance)`` over the pairs worth a look.

    Large stars are cut into tiles that meet pairwise, each pair of tiles in a
    group of its own; only the maximum leaves it.
    """
    nodes = ws.save(nodes, "open")
    counts = SizedKeys(ws, nodes.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["owner"])
    tiles = F.ceil(F.col("n") / TILE_NODES)
    own = F.pmod(F.xxhash64("rk"), tiles)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))
    sized = counts.join(nodes)
    left = sized.withColumn("i", own).withColumn("j", every)
    right = sized.withColumn("j", own).withColumn("i", every).drop("n", "r1")
    keys = ["owner", "i", "j"]
    right = right.select(*[F.col(c).alias("y" if c == "x" else c if c in keys else f"other_{c}")
                           for c in right.columns])
    return (left.join(right, keys).where((F.col("rk") < F.col("other_rk")) & worth)
            .groupBy("owner").agg(F.max(distance).alias("max_distance")))
