"""Greedy star clustering without a serial pass.

The serial rule: walk the nodes in order; the first free node becomes a seed
and takes every free node within the threshold. So a node is a seed exactly
when no earlier seed is in reach (the lexicographically first maximal
independent set; Blelloch, Fineman and Shun, SPAA 2012), and any other node
belongs to the earliest seed in reach.

A *sweep* over the undecided nodes finds the earliest undecided node in the
reach of each: nodes that are their own earliest are seeds, and nodes in reach
of a seed are decided. A sweep keeps one row per node, never the pairs, so a
dense ball of near copies costs what any other nodes cost. Once few pairs are
left among the undecided nodes these are listed, and contiguous ranges of
nodes are settled by one task each: a long chain of near copies that follow
each other in order would otherwise take a sweep per link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.hamming import lowest_within, similar_pairs
from twinsieve.plans.workspace import Workspace

#: Undecided nodes per task when pairs are settled.
RANGE_NODES = 50_000
#: Pairs are listed once they are at most this many per undecided node.
PAIRS_PER_NODE = 64
#: So few undecided nodes have no more pairs than are quickly listed; counting them first would cost as much.
LISTED_NODES = 2_000


class Links:
    """Fingerprints of nodes: ``(rk, fp)``, one row per node and fingerprint.

    ``unique`` tells that each node has one fingerprint, shared with no other;
    then further columns of a node are carried along.
    """

    def __init__(self, ws: Workspace, df: DataFrame, n: int, unique: bool):
        self.ws, self.df, self.n, self.unique = ws, df, n, unique
        #: Columns that stand for a node in the tables of a run.
        self.node = df.columns if unique else ["rk"]

    def earliest(self, target: "Links", threshold: int) -> DataFrame:
        """Nodes with ``low``, the smallest target ``rk`` in reach, if any."""
        values = target.df.select("fp", F.col("rk").alias("val"))
        if self.unique:
            found = lowest_within(self.ws, self.df, values, self.n, target.n, threshold)
            return self.df.join(found, "fp").select(*self.node, "low")
        values = values.groupBy("fp").agg(F.min("val").alias("val"))
        found = lowest_within(self.ws, self.df.select("fp").distinct(), values, self.n, target.n, threshold)
        return self.df.join(found, "fp").groupBy("rk").agg(F.min("low").alias("low"))

    def earliest_here(self, threshold: int) -> DataFrame:
        """``earliest`` among these nodes; each is in its own reach."""
        if not self.unique:
            return self.earliest(self, threshold)
        # Only earlier nodes are worth a row.
        values = self.df.select("fp", F.col("rk").alias("val"))
        found = lowest_within(self.ws, self.df.select("fp", F.col("rk").alias("bound")), values,
                              self.n, self.n, threshold, same=True)
        return self.df.join(found, "fp", "left").select(*self.node, F.coalesce("low", "rk").alias("low"))

    def of(self, nodes: DataFrame, n: int) -> "Links":
        """The links of ``n`` of the nodes."""
        if self.unique:
            return Links(self.ws, nodes.select(*self.node), n, True)
        df, seen = self.ws.save_counted(self.df.join(nodes.select("rk"), "rk", "left_semi"), "links")
        return Links(self.ws, df, seen["n"], False)


def greedy_stars(links: Links, threshold: int) -> DataFrame:
    """Nodes that have a link, with their ``owner``; seeds own themselves."""
    ws, node = links.ws, links.node
    sweep, seen = ws.save_counted(
        links.earliest_here(threshold).select(*node, (F.col("low") == F.col("rk")).alias("seed")),
        "sweep", seeds=F.count_if("seed"))
    seeds, n_seeds = sweep.where("seed").select(*node), seen["seeds"]
    n_others = seen["n"] - n_seeds
    owned = sweep.where("not seed").select(*node, F.lit(None).cast("bigint").alias("owner"))
    all_seeds = seeds
    while n_others:
        # The earliest seed in reach is the owner; seeds found later may be earlier.
        near = links.of(owned, n_others).earliest(links.of(seeds, n_seeds), threshold)
        owned, seen = ws.save_counted(
            owned.join(near.select("rk", "low"), "rk", "left")
            .select(*node, F.least("owner", "low").alias("owner")),
            "owned", free=F.count_if(F.col("owner").isNull()))
        if not seen["free"]:
            break
        free = links.of(owned.where("owner is null"), seen["free"])
        seeds, n_seeds = _next_seeds(free, seen["free"], threshold)
        all_seeds = all_seeds.unionByName(seeds)
        owned = owned.join(seeds.select("rk"), "rk", "left_anti")
        n_others = seen["n"] - n_seeds
    return owned.unionByName(all_seeds.withColumn("owner", F.col("rk")))


def _next_seeds(free: Links, n: int, threshold: int) -> tuple[DataFrame, int]:
    """More seeds among the undecided nodes: all of them if their pairs are few."""
    ws = free.ws
    if free.n > LISTED_NODES and _pair_bound(free, threshold) > PAIRS_PER_NODE * free.n:
        low = free.earliest_here(threshold)
        seeds, seen = ws.save_counted(low.where(F.col("low") == F.col("rk")).select(*free.node), "seeds")
        return seeds, seen["n"]
    pairs = _node_pairs(free, threshold)
    seeds, n_seeds = _settle(ws, free.df.select("rk").distinct(), n, pairs)
    return (free.df.join(seeds, "rk").select(*free.node) if free.unique else seeds), n_seeds


def _pair_bound(free: Links, threshold: int) -> int:
    """Upper bound on the pairs of nodes in reach, without listing them."""
    fps = free.df.groupBy("fp").agg(F.count(F.lit(1)).alias("c"))
    same = fps.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
    pairs = similar_pairs(free.ws, fps.select("fp"), free.n, threshold)
    if not free.unique:
        a = fps.select(F.col("fp").alias("a"), F.col("c").alias("ca"))
        b = fps.select(F.col("fp").alias("b"), F.col("c").alias("cb"))
        apart = pairs.join(a, "a").join(b, "b").agg(F.sum(F.col("ca") * F.col("cb"))).first()[0]
    else:
        apart = pairs.count()
    return int(same) + int(apart or 0)


def _node_pairs(free: Links, threshold: int) -> DataFrame:
    """``(lo, hi)`` of all pairs of nodes in reach, ``lo < hi``."""
    lo = free.df.select(F.col("rk").alias("lo"), F.col("fp").alias("a"))
    hi = free.df.select(F.col("rk").alias("hi"), F.col("fp").alias("b"))
    near = similar_pairs(free.ws, free.df.select("fp").distinct(), free.n, threshold).select("a", "b")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.join(lo, "a").join(hi, "b").where("lo < hi").select("lo", "hi")
    if free.unique:
        return found
    same = lo.join(hi, lo.a == hi.b).where("lo < hi").select("lo", "hi")
    return found.unionByName(same).distinct()


def _settle(ws: Workspace, nodes: DataFrame, n: int, pairs: DataFrame) -> tuple[DataFrame, int]:
    """Seeds of the greedy rule, from listed pairs, and how many they are."""
    parts = max(1, ceil(n / RANGE_NODES))
    if parts > 1:
        pairs = ws.save(pairs, "pairs")
    settled, n_seeds = None, 0
    while True:
        # Rows per node in order: itself, then its earlier neighbours.
        known = pairs.withColumn("seed", F.lit(None).cast("boolean"))
        todo = nodes
        if settled is not None:
            todo = nodes.join(settled, "rk", "left_anti")
            known = (pairs.join(settled.select(F.col("rk").alias("hi")), "hi", "left_anti")
                     .join(settled.select(F.col("rk").alias("lo"), "seed"), "lo", "left")
                     .select("lo", "hi", "seed"))
        rows = known.unionByName(todo.select(F.lit(-1).cast("bigint").alias("lo"), F.col("rk").alias("hi"),
                                             F.lit(None).cast("boolean").alias("seed")))
        rows = rows.repartition(1) if parts == 1 else rows.repartitionByRange(parts, "hi")
        step, seen = ws.save_counted(
            rows.sortWithinPartitions("hi", "lo").select("lo", "hi", "seed")
            .mapInPandas(_settle_range, "rk bigint, seed boolean"),
            "settled", open=F.count_if(F.col("seed").isNull()), seeds=F.count_if("seed"))
        n_seeds += seen["seeds"]
        new = step.where("seed is not null")
        settled = new if settled is None else settled.unionByName(new)
        if not seen["open"]:
            return settled.where("seed").select("rk"), n_seeds


def _settle_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply the greedy rule to one range of nodes, sorted by ``(hi, lo)``.

    A node stays open (NULL) if an earlier neighbour outside the range, or one
    that is itself open, could still be a seed.
    """
    state: dict[int, bool | None] = {}
    node, verdict = None, True
    for batch in batches:
        done: list[tuple[int, bool | None]] = []
        for lo, hi, seed in zip(batch["lo"].tolist(), batch["hi"].tolist(), batch["seed"].tolist()):
            if hi != node:
                if node is not None:
                    done.append((node, verdict))
                    state[node] = verdict
                node, verdict = hi, True
            if lo < 0 or verdict is False:
                continue
            other = state.get(lo) if seed is None else seed
            if other:
                verdict = False
            elif other is None:
                verdict = None
        yield pd.DataFrame(done, columns=["rk", "seed"]).astype({"rk": "int64", "seed": "object"})
    if node is not None:
        yield pd.DataFrame({"rk": [node], "seed": pd.Series([verdict], dtype="object")})
