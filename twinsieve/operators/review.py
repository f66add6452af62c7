"""Marks, the guard against wiping out a group, and deletion sets.

``marks(path)`` is a set of paths to delete, ``members`` the long form of
groups. Everything answers for all groups in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import fingerprints as fp
from twinsieve.functions.paths import folder_index, path_tokens
from twinsieve.operators.groups import canonical, group_table
from twinsieve.operators.spread import SMALL_STAR, frame_star_spread, small_spread, star_spread
from twinsieve.plans.skew import SizedKeys
from twinsieve.plans.workspace import Workspace

SEPARATORS = ("/", "\\")


class ExtinctionError(RuntimeError):
    """A deletion would leave groups without a file; ``groups`` has ``(group_id, n_files)`` of each."""

    def __init__(self, message: str, groups: DataFrame | None = None):
        super().__init__(message)
        self.groups = groups


def add_marks(marks: DataFrame, paths: DataFrame) -> DataFrame:
    return marks.select("path").unionByName(paths.select("path")).distinct()


def remove_marks(marks: DataFrame, paths: DataFrame) -> DataFrame:
    return marks.select("path").join(paths.select("path"), "path", "left_anti")


def mark_groups(marks: DataFrame, members: DataFrame, group_ids: DataFrame) -> DataFrame:
    """Mark every file of the groups."""
    return add_marks(marks, members.join(group_ids.select("group_id"), "group_id", "left_semi"))


def keep_groups(marks: DataFrame, members: DataFrame, group_ids: DataFrame) -> DataFrame:
    """Unmark every file of the groups."""
    return remove_marks(marks, members.join(group_ids.select("group_id"), "group_id", "left_semi"))


def _with_marks(members: DataFrame, marks: DataFrame) -> DataFrame:
    flags = marks.select("path").distinct().withColumn("marked", F.lit(True))
    return members.join(flags, "path", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def survivors(members: DataFrame, marks: DataFrame) -> DataFrame:
    """Per group the files left and marked, and whether marks leave none."""
    return (_with_marks(members, marks).groupBy("group_id")
            .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("marked")).alias("survivors"),
                 F.count_if("marked").alias("marked"))
            .withColumn("no_survivors", (F.col("survivors") == 0) & (F.col("marked") > 0)))


def is_last_copy(members: DataFrame, marks: DataFrame, group_id: str, path: str) -> bool:
    """Whether marking ``path`` too would leave its group without a file."""
    others = members.where((F.col("group_id") == group_id) & (F.col("path") != path))
    return others.join(marks.select("path"), "path", "left_anti").isEmpty()


def extinct_groups(members: DataFrame, marks: DataFrame) -> DataFrame:
    """``(group_id, n_files)`` of the groups that deletion would wipe out."""
    return survivors(members, marks).where("survivors = 0").select("group_id", "n_files")


def guard(members: DataFrame, marks: DataFrame) -> None:
    """Raise ExtinctionError, with all of them, if any group would lose all its files."""
    lost = extinct_groups(members, marks)
    some = [r.group_id for r in lost.orderBy("group_id").limit(10).collect()]
    if some:
        raise ExtinctionError("groups without survivors, all of them in .groups, the first: " + ", ".join(some), lost)


def deletion_manifest(marks: DataFrame, members: DataFrame) -> DataFrame:
    """``(path, group_ids, size)`` per marked path, for the tool that deletes.

    A path is in at most one group of each kind, so the array stays short.
    """
    marked = members.join(marks.select("path"), "path", "left_semi")
    per_path = marked.groupBy("path").agg(F.sort_array(F.collect_set("group_id")).alias("group_ids"),
                                          F.max("size").alias("size"))
    return (marks.select("path").distinct().join(per_path, "path", "left")
            .select("path", F.coalesce("group_ids", F.array().cast("array<string>")).alias("group_ids"), "size"))


def remaining_members(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members of the groups that keep at least two files."""
    left = members.join(deleted.select("path"), "path", "left_anti").select(*members.columns)
    small = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return left.join(small.select("group_id"), "group_id", "left_semi")


def group_distances(ws: Workspace, members: DataFrame, records: DataFrame) -> DataFrame:
    """``(group_id, max_distance)`` of perceptual groups from the fingerprints of their members."""
    keyed = (members.where(F.col("duplicate_type") == "perceptual").select("group_id", "path")
             .join(records.select("path", "phash"), "path")
             .select(F.col("group_id").alias("owner"), canonical("phash").alias("rk")).distinct())
    counted = keyed.groupBy("owner").agg(F.count(F.lit(1)).alias("nodes"), F.max(fp.is_multi("rk")).alias("multi"))
    sized = SizedKeys(ws, counted, ["owner"], "nodes")
    rows = ws.save(sized.join(keyed), "nodes")
    single = rows.where("not multi").withColumn("x", fp.parse_hex("rk"))
    multi = rows.where("multi").withColumn("x", fp.split_frames("rk"))
    found = small_spread(single, fp.hamming("x", "y")).unionByName(
        small_spread(multi, fp.min_frame_distance("x", "y")))
    large = F.col("nodes") > SMALL_STAR
    if not sized.df.where(large).isEmpty():
        found = found.unionByName(star_spread(ws, single.where(large))).unionByName(
            frame_star_spread(ws, multi.where(large)))
    return (sized.df.join(found, "owner", "left")
            .select(F.col("owner").alias("group_id"), F.coalesce("max_distance", F.lit(0)).alias("max_distance")))


def apply_deletions(ws: Workspace, members: DataFrame, records: DataFrame, marks: DataFrame,
                    allow_extinction: bool = False, recompute: bool = True, went: DataFrame | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(groups, members, records, manifest) after the marked paths are gone.

    Unless allowed, nothing happens if any group would be left without a file.
    ``went`` (path) has the paths that were really deleted, as the deleting tool reports; marked ones that it lacks stay.
    Distances change only in groups that lost a file. ``recompute=False`` keeps the freed bytes and distances of before.
    """
    if not allow_extinction:
        guard(members, marks)
    manifest = deletion_manifest(marks, members)
    if went is not None:
        manifest = manifest.join(went.select("path"), "path", "left_semi")
    manifest = ws.save(manifest, "manifest")
    left = remaining_members(members, manifest)
    if recompute and "phash" in records.columns:
        left = ws.save(left, "left")
        touched = manifest.select(F.explode("group_ids").alias("group_id")).distinct()
        distances = (group_distances(ws, left.join(touched, "group_id", "left_semi"), records)
                     .withColumnRenamed("max_distance", "now"))
        left = (left.join(distances, "group_id", "left")
                .withColumn("max_distance", F.coalesce("now", "max_distance")).select(*members.columns))
    left = ws.save(left, "left")
    groups = group_table(left)
    if not recompute:
        before = group_table(members).select("group_id", "wasted_bytes")
        groups = groups.drop("wasted_bytes").join(before, "group_id").select(*groups.columns)
    kept = records.join(manifest.select("path"), "path", "left_anti").select(*records.columns)
    return groups, left, kept, manifest


def marked_totals(marks: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how many paths are marked and the bytes they hold, once per path."""
    marked = members.join(marks.select("path"), "path", "left_semi")
    sizes = marked.groupBy("path").agg(F.max("size").alias("size"))
    total = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    return (marks.select("path").distinct().join(sizes, "path", "left")
            .agg(F.count(F.lit(1)).alias("n_marked"), total.alias("bytes"))
            .withColumn("mib", fp.mebibytes("bytes", 1)))


def best_in_group(ws: Workspace, members: DataFrame, areas: DataFrame) -> DataFrame:
    """``(group_id, path, area)`` of all files with the largest known area of their group."""
    sized = members.select("group_id", "path").join(areas.select("path", "area"), "path")
    best = SizedKeys(ws, sized.groupBy("group_id").agg(F.max("area").alias("best"), F.count(F.lit(1)).alias("n"))
                     .where("best > 0"), ["group_id"], label="best")
    return best.join(sized).where("area = best").select("group_id", "path", "area")


def common_prefix(members: DataFrame) -> DataFrame:
    """``(group_id, prefix)``: the folders all paths share, without trailing separators.

    What the smallest and the largest token list share, all share; so two
    aggregates do, whatever the size of the group.
    """
    ends = members.select("group_id", path_tokens("path").alias("t")).groupBy("group_id").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    places = F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi")))
    differ = F.array_min(F.filter(places, lambda i: F.element_at("lo", i) != F.element_at("hi", i)))
    shared = F.coalesce(differ - 1, F.least(F.size("lo"), F.size("hi")))
    names = F.filter(places, lambda i: (i <= F.col("shared")) & ~F.element_at("lo", i).isin(*SEPARATORS))
    text = F.array_join(F.slice("lo", 1, F.coalesce(F.array_max(names), F.lit(0))), "")
    return (ends.withColumn("shared", shared)
            .select("group_id", F.when(F.col("n") < 2, "").otherwise(text).alias("prefix")))


def folder_matrix(members: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Files per group and folder, in columns ``f0``, ``f1``, ..."""
    folder = folder_index("path", folders)
    return members.groupBy("group_id").agg(
        *[F.count_if(folder == i).alias(f"f{i}") for i in range(len(folders))])


def column_paths(members: DataFrame, folders: Sequence[str], index: int) -> DataFrame:
    """Paths of one folder column, to be marked together."""
    return members.where(folder_index("path", folders) == index).select("path").distinct()


def mark_column_preview(members: DataFrame, marks: DataFrame, folders: Sequence[str]) -> DataFrame:
    """``(folder_idx, group_id)``: groups without survivors once all files of a folder are marked too.

    Groups that marks already wipe out count under every folder.
    """
    folder = folder_index("path", folders)

    def all_gone(i: int) -> Column:
        return F.bool_and(F.col("marked") | (folder == i)).alias(f"gone{i}")

    flags = _with_marks(members, marks).groupBy("group_id").agg(*[all_gone(i) for i in range(len(folders))])
    gone = F.array(*[F.when(F.col(f"gone{i}"), i) for i in range(len(folders))])
    return (flags.select(F.explode(gone).alias("folder_idx"), "group_id")
            .where(F.col("folder_idx").isNotNull()))
