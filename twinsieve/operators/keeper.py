"""Which file of each group to keep, and the marks that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.paths import order_key, priority_index
from twinsieve.plans.skew import SizedKeys
from twinsieve.plans.workspace import Workspace

# Names of the two rules.
KEEPER_MODES = ("priority", "quality")


def keepers(members: DataFrame, priorities: Sequence[str], mode: str = "priority",
            areas: DataFrame | None = None) -> DataFrame:
    """``(group_id, keeper, n)``: one path per group.

    ``priority``: the file under the foremost folder, the first of several.
    ``quality``: the largest pixel area from ``areas(path, area)``, then the
    foremost folder, the last of several; without an area a file counts 0.
    """
    if mode not in KEEPER_MODES:
        raise ValueError(f"mode must be one of {KEEPER_MODES}, got {mode!r}")
    rank = priority_index("path", priorities)
    if mode == "priority":
        best = F.min_by("path", F.struct(rank, order_key("path")))
    else:
        area = F.lit(0).cast("bigint")
        if areas is not None:
            members = members.join(areas.select("path", "area"), "path", "left")
            area = F.coalesce("area", area)
        best = F.max_by("path", F.struct(area, -rank, order_key("path")))
    return members.groupBy("group_id").agg(best.alias("keeper"), F.count(F.lit(1)).alias("n"))


def _all_but(ws: Workspace, members: DataFrame, kept: DataFrame) -> DataFrame:
    sized = SizedKeys(ws, kept, ["group_id"], label="kept")
    return (sized.join(members.select("group_id", "path"))
            .where(F.col("path") != F.col("keeper")).select("group_id", "path"))


def auto_mark(ws: Workspace, members: DataFrame, priorities: Sequence[str], mode: str = "priority",
              areas: DataFrame | None = None) -> DataFrame:
    """``(group_id, path)`` of all files but the keeper, for every group at once."""
    return _all_but(ws, members, keepers(members, priorities, mode, areas))


def auto_mark_group(ws: Workspace, members: DataFrame, group_id: str, priorities: Sequence[str],
                    mode: str = "priority", areas: DataFrame | None = None) -> DataFrame:
    """As ``auto_mark`` for one group, which must exist."""
    one = members.where(F.col("group_id") == group_id)
    if one.isEmpty():
        raise LookupError(f"no group {group_id}")
    return auto_mark(ws, one, priorities, mode, areas)


def keep_nth(ws: Workspace, members: DataFrame, nth: int) -> DataFrame:
    """``(group_id, path)`` of all files but the n-th of each group, counting from 1.

    Groups of fewer files are left alone. Spark cuts each group to ``nth`` rows
    before the shuffle, so its size does not matter.
    """
    if nth < 1:
        raise ValueError("nth counts from 1")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(order_key("path")))
    kept = (members.select("group_id", "path").withColumn("place", place).where(F.col("place") <= nth)
            .where(F.col("place") == nth).select("group_id", F.col("path").alias("keeper")))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return _all_but(ws, members, kept.join(sizes, "group_id"))
