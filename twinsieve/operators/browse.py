"""Filter, sort and page result groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from twinsieve.functions.paths import extension

# Names of the sort orders and the groups on a page.
SORTS = {
    "default": None,
    "files-desc": ("n_files", False),
    "files-asc": ("n_files", True),
    "size-desc": ("wasted_bytes", False),
    "size-asc": ("wasted_bytes", True),
}
PAGE_SIZE = 50


def groups_all_ext(groups: DataFrame, members: DataFrame, ext: str) -> DataFrame:
    """Groups whose every file has the extension, given with its dot."""
    same = (members.groupBy("group_id").agg(F.bool_and(extension("path", "dotted") == ext).alias("same"))
            .where("same").select("group_id"))
    return groups.join(same, "group_id", "left_semi")


def sort_groups(groups: DataFrame, order: str = "default") -> DataFrame:
    """Sort by files or freed bytes; ties, and the default, by kind and first path."""
    if order not in SORTS:
        raise ValueError(f"order must be one of {tuple(SORTS)}, got {order!r}")
    ties = [F.asc("duplicate_type"), F.asc("first_key"), F.asc("group_id")]
    if SORTS[order] is None:
        return groups.orderBy(*ties)
    name, up = SORTS[order]
    return groups.orderBy(F.asc(name) if up else F.desc(name), *ties)


def page_of_groups(groups: DataFrame, page: int, order: str = "default", page_size: int = PAGE_SIZE) -> DataFrame:
    """One page, counting from 0; beyond the end, the last one.

    A page far down gathers all before it; to go through many, use ``page_after``.
    """
    pages = max(1, -(-groups.count() // page_size))
    return sort_groups(groups, order).offset(min(page, pages - 1) * page_size).limit(page_size)


def page_after(groups: DataFrame, last: Row | None, order: str = "default", page_size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows the group ``last`` of the one before, or the first page.

    It is sought by the sort keys, so no page costs more than the first, however far down it is.
    """
    if order not in SORTS:
        raise ValueError(f"order must be one of {tuple(SORTS)}, got {order!r}")
    keys = [("duplicate_type", True), ("first_key", True), ("group_id", True)]
    keys = ([SORTS[order]] if SORTS[order] else []) + keys
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, up in keys:
            column, value = F.col(name), F.lit(last[name])
            beyond |= equal & (column > value if up else column < value)
            equal &= column == value
        groups = groups.where(beyond)
    return sort_groups(groups, order).limit(page_size)


def one_group(groups: DataFrame, group_id: str) -> DataFrame:
    """The group of this id, which must exist."""
    found = groups.where(F.col("group_id") == group_id)
    if found.isEmpty():
        raise LookupError(f"no group {group_id}")
    return found


def image_files(members: DataFrame) -> DataFrame:
    return members.where(F.col("media_type") == "image")


def available_exts(members: DataFrame) -> DataFrame:
    """Distinct extensions with their dot, sorted; files without one do not count."""
    return (members.select(extension("path", "dotted").alias("ext")).where("ext <> ''")
            .distinct().orderBy("ext"))


def ext_counts(files: DataFrame) -> DataFrame:
    """``(ext, n)`` by falling count; ``(none)`` stands for no extension."""
    ext = extension("path")
    shown = F.when(ext == "", "(none)").otherwise(F.concat(F.lit("."), ext))
    return files.groupBy(shown.alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext")


def result_summary(groups: DataFrame, members: DataFrame, ext: str | None = None) -> DataFrame:
    """One row: groups in all, groups the extension filter shows, the line for the reader."""
    shown = groups if ext is None else groups_all_ext(groups, members, ext)
    visible = shown.agg(F.count(F.lit(1)).alias("visible"))
    total = groups.agg(F.count(F.lit(1)).alias("total"))
    # The texts of the line.
    plural = F.when(F.col("total") == 1, "").otherwise("s")
    counted = F.concat(F.col("total").cast("string"), F.lit(" group"), plural)
    text = F.concat(F.col("visible").cast("string"), F.lit(" of "), counted) if ext else \
        F.concat(counted, F.lit(" found"))
    both = total.withColumn("one", F.lit(1)).join(visible.withColumn("one", F.lit(1)), "one")
    return both.select("total", "visible",
                       F.when(F.col("total") == 0, "No duplicates found").otherwise(text).alias("label"))
