"""Video fingerprints from a table of hashed frames.

``frames(path, frame_idx, position, fp)`` holds one row per decoded frame;
``position`` is its place in the video, from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import join_frames, sample_windows, to_hex
from twinsieve.options import VIDEO_STRATEGIES

# Where single frames are taken, as shares of the duration.
FIRST_FRAME_AT = 0.05
MIDDLE_FRAME_AT = 0.5


def _nearest(at: float) -> Column:
    return F.min_by("fp", F.struct(F.abs(F.col("position") - F.lit(at)), "frame_idx"))


def video_fingerprints(frames: DataFrame, strategy: str = "first_frame", frame_count: int = 8) -> DataFrame:
    """``(path, phash)`` per video, NULL where the strategy finds no frame.

    ``exact_only`` hashes none; ``first_frame`` takes the frame nearest to the
    start; ``multi_frame`` joins all frames in order, or takes the middle one
    when a single frame is asked for. Pass frames chosen by ``sampled_frames``.
    """
    if strategy not in VIDEO_STRATEGIES:
        raise ValueError(f"strategy must be one of {VIDEO_STRATEGIES}, got {strategy!r}")
    per_video = frames.where(F.col("fp").isNotNull()).groupBy("path") if strategy != "exact_only" else None
    if per_video is None:
        return frames.select("path", F.lit(None).cast("string").alias("phash")).distinct()
    if strategy == "first_frame":
        return per_video.agg(to_hex(_nearest(FIRST_FRAME_AT)).alias("phash"))
    if max(frame_count, 1) == 1:
        return per_video.agg(to_hex(_nearest(MIDDLE_FRAME_AT)).alias("phash"))
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", "fp")))
    return per_video.agg(join_frames(F.transform(ordered, lambda f: f.fp)).alias("phash"))


def sampled_frames(frames: DataFrame, durations: DataFrame, frame_count: int) -> DataFrame:
    """Frames that fall into the sample windows of their video.

    ``frames`` has ``second``, the time of the frame, and ``durations`` is
    ``(path, duration)``.
    """
    windows = durations.select("path", sample_windows("duration", frame_count).alias("windows"))
    inside = F.exists("windows", lambda w: (F.col("second") >= w.start) & (F.col("second") <= w.end))
    return frames.join(windows, "path").where(inside).drop("windows")
