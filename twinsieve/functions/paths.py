"""Column expressions over file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions that count as media.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "heic", "avif")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "m4v", "3gp")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(path: Column | str) -> Column:
    """String whose byte order is the component-wise order of paths.

    NUL cannot occur in a path and sorts before every other byte, so
    ``/a/b`` comes before ``/a-b/x``.
    """
    return F.replace(_col(path), F.lit("/"), F.lit("\0"))


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def name_key(path: Column | str) -> Column:
    """Lower-cased file name, the name half of the filename duplicate key."""
    return F.lower(basename(path))


def extension(path: Column | str, style: str = "catalog") -> Column:
    """Lower-cased extension, empty when there is none.

    ``catalog``: without the dot; a leading dot starts a hidden name, not an
    extension (``.git`` has none). ``dotted``: with the dot, after the last
    separator of either kind (``.git`` is its own extension).
    """
    if style == "catalog":
        return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1))
    if style == "dotted":
        return F.lower(F.regexp_extract(_col(path), r"(\.[^.\\/]*)$", 1))
    raise ValueError(f"unknown style {style!r}")


def media_type(path: Column | str) -> Column:
    """``image``, ``video`` or NULL by extension, ignoring case."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def priority_index(path: Column | str, priorities: Sequence[str]) -> Column:
    """Index of the first priority that is a raw prefix of the path.

    No separator is required after the prefix. Without a match the largest
    INT is returned, the lowest priority.
    """
    none = F.lit(2**31 - 1)
    if not priorities:
        return none
    out = F.when(F.startswith(_col(path), F.lit(priorities[0])), 0)
    for i, prefix in enumerate(priorities[1:], start=1):
        out = out.when(F.startswith(_col(path), F.lit(prefix)), i)
    return out.otherwise(none)


def folder_index(path: Column | str, folders: Sequence[str]) -> Column:
    """Index of the longest folder that holds the path, -1 without one.

    Here a folder must end at a separator; backslashes count as slashes, one
    trailing slash is ignored, and of equal folders the first wins.
    """
    slashed = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    cleaned = [f.replace("\\", "/").removesuffix("/") for f in folders]
    out = F.lit(-1)
    # Built inside out: the longest folder (then the first) is tested first.
    for i in sorted(range(len(cleaned)), key=lambda i: (len(cleaned[i]), -i)):
        inside = F.startswith(slashed, F.lit(cleaned[i] + "/")) | (slashed == F.lit(cleaned[i]))
        out = F.when(inside, i).otherwise(out)
    return out


def path_tokens(path: Column | str) -> Column:
    """Path split at separators, which are tokens of their own."""
    return F.split(F.regexp_replace(_col(path), r"([\\/])", "\0$1\0"), "\0")
