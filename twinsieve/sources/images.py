"""Image fingerprints through Spark's image source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import to_hex
from twinsieve.functions.paths import media_type
from twinsieve.functions.rasters import dhash_image
from twinsieve.sources.catalog import existing, literal_path, plain_path

#: Larger image files are not decoded: a file must fit a row, and Spark's rows end at 2 GiB.
LARGEST_IMAGE_BYTES = 1 << 30


def origin_path(origin: Column | str) -> Column:
    """Catalog path of an image origin, which is a percent-encoded URI."""
    origin = F.col(origin) if isinstance(origin, str) else origin
    return plain_path(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))))


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    if not paths:
        return None
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(paths)


def image_fingerprints(spark: SparkSession, folders: Sequence[str], changed_from: int | None = None,
                       paths: Sequence[str] | None = None) -> DataFrame:
    """``(path, width, height, phash)`` of the images below the folders, or of ``paths`` only.

    What cannot be decoded has NULLs. Names, sizes and times are conditions on the listing: videos, other files, too
    large ones and (with ``changed_from``, in seconds) older ones are never opened.
    """
    try:
        listed = _listed(spark, existing(spark, folders) if paths is None else list(map(literal_path, paths)))
    except AnalysisException:  # one of the paths has gone since it was listed
        if paths is None:
            raise
        listed = _listed(spark, [literal_path(p) for p in existing(spark, paths, True)])
    if listed is None:
        return spark.createDataFrame([], "path string, width int, height int, phash string")
    images = (listed.where(media_type("_metadata.file_name") == "image")
              .where(F.col("_metadata.file_size") <= LARGEST_IMAGE_BYTES))
    if changed_from is not None:
        images = images.where(F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(changed_from)))
    ok = F.col("image.height") > 0
    fp = dhash_image("image.height", "image.width", "image.nChannels", "image.data")
    return images.select(origin_path("image.origin").alias("path"),
                         F.when(ok, F.col("image.width")).alias("width"),
                         F.when(ok, F.col("image.height")).alias("height"), to_hex(fp).alias("phash"))
