"""Catalog of media files under folders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.paths import media_type
from twinsieve.schemas import FILES

# Schemes of Hadoop's file systems that the readers on executors know by another name.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "abfss://": "abfs://"}
#: Paths whose file system these readers know: local ones and those of some schemes.
DIRECT = r"^(/|(file|hdfs|s3|s3a|s3n|gs|gcs|abfs|abfss):)"


def plain_path(uri: Column | str) -> Column:
    """Local URIs without their scheme; others as they are."""
    return F.regexp_replace(uri, "^file:/+", "/")


def literal_path(path: str) -> str:
    """A path as the readers take it: without meaning for the characters of patterns."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def existing(spark: SparkSession, folders: Sequence[str], known_only: bool = False) -> list[str]:
    """The folders that exist, as the file system of each tells.

    Those of a file system that Spark does not know are an error, or left out with ``known_only``.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        try:
            if path.getFileSystem(conf).exists(path):
                found.append(folder)
        except Py4JJavaError as e:
            if not (known_only and "UnsupportedFileSystemException" in str(e.java_exception)):
                raise
    return found


def binary_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))


def describe(files: DataFrame) -> DataFrame:
    """Catalog columns of rows of the binaryFile source; contents are not read."""
    path = plain_path("path")
    seconds = F.greatest(F.unix_seconds("modificationTime"), F.lit(0).cast("bigint"))
    return (files.select(path.alias("path"), F.col("length").alias("size"), seconds.alias("mtime"))
            .withColumn("media_type", media_type("path")).where("media_type is not null"))


def list_media(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``(path, size, mtime, media_type)`` of the media files below the folders.

    Folders that do not exist hold nothing; overlapping ones give a file once.
    Spark leaves out names that start with ``_`` or ``.`` and follows links;
    where that matters, pass a catalog made otherwise through ``keep_media``.
    """
    found = existing(spark, folders)
    if not found:
        return spark.createDataFrame([], FILES)
    return describe(binary_files(spark, found)).dropDuplicates(["path"])


def keep_media(files: DataFrame) -> DataFrame:
    """Classify and filter a catalog ``(path, size, mtime, ...)``, each path once."""
    kept = files.withColumn("media_type", media_type("path")).where("media_type is not null")
    return kept.dropDuplicates(["path"])
