"""Options of a scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted names and the defaults of a scan.
MODES = ("filename", "content", "both")
VIDEO_STRATEGIES = ("exact_only", "first_frame", "multi_frame")
DEFAULT_THRESHOLD = 8
DEFAULT_FRAME_COUNT = 8


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return mode


def check_threshold(threshold: int) -> int:
    if not 0 <= threshold <= 64:
        raise ValueError(f"threshold must lie in 0..64, got {threshold}")
    return threshold


@dataclass(frozen=True)
class ScanOptions:
    folders: tuple[str, ...] = ()
    mode: str = "both"
    video_strategy: str = "first_frame"
    phash_threshold: int = DEFAULT_THRESHOLD
    folder_priorities: tuple[str, ...] = ()
    multi_frame_count: int = DEFAULT_FRAME_COUNT

    def __post_init__(self) -> None:
        check_mode(self.mode)
        check_threshold(self.phash_threshold)
        if self.video_strategy not in VIDEO_STRATEGIES:
            raise ValueError(f"video_strategy must be one of {VIDEO_STRATEGIES}")

    @property
    def perceptual(self) -> bool:
        return self.mode in ("content", "both")

    @property
    def fp_profile(self) -> str:
        """What a stored fingerprint of a video depends on besides the file, if its frames were at hand."""
        if not self.perceptual:
            return "names"
        strategy = self.video_strategy
        if strategy == "multi_frame":
            strategy += f":{max(self.multi_frame_count, 1)}"
        return f"sha256+{strategy}"

    def profile_of(self, media_type: Column, hashed: Column, large: Column | None = None) -> Column:
        """The profile of each row: images do not depend on how videos are hashed.

        ``hashed`` tells whether a video's frames were at hand. A row stored under another profile is a miss, so that an
        incremental run gives what a full one would. ``large`` tells of files whose content is digested as a tree.
        """
        kind = F.when(media_type == "image", "sha256+dhash").when(hashed, self.fp_profile).otherwise("sha256")
        return kind if large is None else F.when(large, F.concat(F.lit("tree:"), kind)).otherwise(kind)
