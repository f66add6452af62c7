"""From folders to fingerprinted records, and on to groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import pixel_area
from twinsieve.operators.groups import find_duplicates
from twinsieve.options import ScanOptions
from twinsieve.plans.workspace import Workspace
from twinsieve.sources.catalog import DIRECT, list_media
from twinsieve.sources.digests import digest_named
from twinsieve.sources.frames import video_fingerprints
from twinsieve.sources.images import image_fingerprints
from twinsieve.sources.opening import WHOLE_FILE_BYTES, digest_files
from twinsieve.sources.snapshot import Snapshot, split_by_store, store_stats

#: Paths that are handed to one of Spark's readers at once.
BLOCK_PATHS = 10_000
RECORD_COLUMNS = ["path", "size", "mtime", "media_type", "exact_hash", "phash", "width", "height",
                  "fp_profile", "error"]


@dataclass(frozen=True)
class ScanResult:
    """Records of a scan, its groups and members, and what the store knew (nothing in filename mode)."""

    records: DataFrame
    groups: DataFrame
    members: DataFrame
    stats: DataFrame | None


def fingerprint(ws: Workspace, files: DataFrame, store: Snapshot | None, options: ScanOptions,
                frames: DataFrame | None = None) -> DataFrame:
    """Records of a catalog, one per path; only new or changed files are opened, then stored.

    In filename mode nothing is opened, and the store is neither read nor written. Files that could not be read have
    ``error`` set and are not stored. A video that had no frames is stored as one without a hash, so that it is hashed
    once its frames are there.
    """
    files = ws.save(files.select("path", "size", "mtime", "media_type").dropDuplicates(["path"]), "files")
    if not options.perceptual:
        return _blank(files, "exact_hash", "phash", "fp_profile", "error", width="int", height="int").select(*RECORD_COLUMNS)
    files = ws.save(_with_frames(files, frames), "files")
    hits, misses = None, files.withColumn("fp_profile", _profile(options))
    if store:
        hits, misses = split_by_store(files, ws.save(store.read(), "stored"), _profile(options))
    misses, seen = ws.save_counted(misses, "misses")
    if not seen["n"]:
        new = _blank(misses, "exact_hash", "phash", "error", width="int", height="int")
    else:
        new = _with_hashes(ws, ws.save(_with_digests(ws, misses), "digested"), options, frames)
    new = ws.save(new.select(*RECORD_COLUMNS), "new")
    if store and seen["n"]:
        store.upsert(new.where("error is null").drop("error"))
    if hits is None:
        return new
    return hits.withColumn("error", F.lit(None).cast("string")).select(*RECORD_COLUMNS).unionByName(new)


def _with_frames(files: DataFrame, frames: DataFrame | None) -> DataFrame:
    if frames is None:
        return files.withColumn("framed", F.lit(False))
    known = frames.where("fp is not null").select("path", F.lit(True).alias("framed")).distinct()
    return files.join(known, "path", "left").withColumn("framed", F.coalesce("framed", F.lit(False)))


def _profile(options: ScanOptions) -> Column:
    return options.profile_of(F.col("media_type"), F.col("framed"), F.col("size") > WHOLE_FILE_BYTES)


def _blank(df: DataFrame, *strings: str, **typed: str) -> DataFrame:
    for name, kind in {**dict.fromkeys(strings, "string"), **typed}.items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _by_blocks(ws: Workspace, paths: DataFrame, read: Callable[[list[str]], DataFrame], label: str) -> DataFrame | None:
    """What ``read`` makes of all ``paths``, a block of them at a time, each a written table."""
    out, last = None, None
    ordered = ws.save(paths.select("path").orderBy("path"), "paths")
    while True:
        rest = ordered if last is None else ordered.where(F.col("path") > last)
        block = [r["path"] for r in rest.orderBy("path").limit(BLOCK_PATHS).collect()]
        if not block:
            return out
        found = ws.save(read(block).dropDuplicates(["path"]), label)
        out = found if out is None else out.unionByName(found)
        last = block[-1]


def _with_digests(ws: Workspace, new: DataFrame) -> DataFrame:
    """``new`` with ``exact_hash`` or ``error``: each file is opened once, by the executors, whatever their number.

    Where only Spark's readers know a file system, files are read by name.
    """
    direct = F.col("path").rlike(DIRECT)
    digests = digest_files(ws, new.where(direct).select("path", "size"))
    other = _by_blocks(ws, new.where(~direct), lambda block: digest_named(ws.spark, block), "named")
    if other is not None:
        reason = F.when(F.col("exact_hash").isNull(), F.lit("the file is gone, too large, or of an unknown file system"))
        digests = digests.unionByName(new.where(~direct).select("path").join(other, "path", "left").withColumn("error", reason))
    return new.join(digests, "path", "left")


def _with_hashes(ws: Workspace, new: DataFrame, options: ScanOptions, frames: DataFrame | None) -> DataFrame:
    """Images get the hash of the image, videos that of their frames; each path meets one row at most."""
    readable = new.where((F.col("media_type") == "image") & F.col("error").isNull())
    hashed = _by_blocks(ws, readable, lambda block: image_fingerprints(ws.spark, (), paths=block), "images")
    if frames is not None:
        videos = video_fingerprints(frames.join(new.where("media_type = 'video'").select("path"), "path", "left_semi"),
                                    options.video_strategy, options.multi_frame_count)
        videos = _blank(videos, width="int", height="int")
        hashed = videos if hashed is None else hashed.unionByName(videos)
    if hashed is None:
        return _blank(new, "phash", width="int", height="int")
    return new.join(hashed, "path", "left")


def scan(ws: Workspace, options: ScanOptions, store: Snapshot | None = None,
         frames: DataFrame | None = None) -> ScanResult:
    """Catalog, fingerprint and group the media below the folders of the options."""
    files = ws.save(list_media(ws.spark, options.folders), "catalog")
    before = None
    if store and options.perceptual:
        before = ws.save(store_stats(_with_frames(files, frames), store.read(), _profile(options)), "stats")
    records = ws.save(fingerprint(ws, files, store, options, frames), "records")
    groups, members = find_duplicates(ws, records, options.mode, options.phash_threshold, unique_paths=True)
    return ScanResult(records, groups, members, before)


def image_areas(records: DataFrame) -> DataFrame:
    """``(path, area)`` in pixels, 0 where unknown, for choosing keepers."""
    return records.select("path", pixel_area("width", "height").alias("area"))
