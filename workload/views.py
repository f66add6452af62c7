"""Views over the given tables that look like a file library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import parse_hex, to_hex
from twinsieve.operators.groups import first_per_path

# Folders in order of priority.
PRIORITIES = ["/lib/src1", "/lib/src2/en", "/lib/src2", "/lib/src"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether it is one file or a folder of them.

    A stream takes a path without a pattern for a folder, so the path has one that only this name fits.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def files_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    kind = F.col("n_chars") % 5
    ext = F.when(kind == 1, ".PNG").when(kind == 2, ".mp4").when(kind == 4, ".txt").otherwise(".jpg")
    short = F.concat(F.lit("f"), F.substring(F.md5(text), 1, 5))
    name = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("g"), F.col("doc_id")))
            .when(F.col("doc_id") % 2 == 0, F.upper(short)).otherwise(short))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), name, ext).alias("path"),
        F.col("n_chars").alias("size"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime"), ext.alias("ext"),
        F.when(kind == 2, "video").when(kind != 4, "image").alias("media_type"),
        F.when(F.col("doc_id") % 17 != 0, F.sha2(text, 256)).alias("exact_hash"))


def media_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_path(files_docs(spark, sf_dir).where("media_type is not null"), "doc_id")


def dhash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(
        "lower(lpad(hex(aggregate(sequence(1, 63), 0L, (acc, i) -> case when "
        "element_at(embedding, i) > element_at(embedding, i + 1) then acc | shiftleft(1L, i - 1) "
        "else acc end)), 16, '0'))").alias("phash"))


def dhash_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = dhash_embeddings(spark, sf_dir).select(F.col("vec_id").alias("base_id"), parse_hex("phash").alias("fp"))
    ids = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") - F.col("vec_id") % 3).alias("base_id"))
    flip = F.expr("case vec_id % 3 when 0 then 0L when 1 then shiftleft(1L, cast(vec_id % 61 as int)) "
                  "else shiftleft(1L, 5) | shiftleft(1L, 17) | shiftleft(1L, 40) end")
    return ids.join(base, "base_id").select("vec_id", to_hex(F.col("fp").bitwiseXOR(flip)).alias("phash"))


def records_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = dhash_planted(spark, sf_dir).where("vec_id % 13 <> 0").withColumnRenamed("vec_id", "doc_id")
    return media_docs(spark, sf_dir).join(near, "doc_id", "left")


def frames_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dhash_embeddings(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 4).cast("string").alias("video"),
        (F.col("vec_id") % 4).cast("int").alias("frame_idx"), "phash")


def luma_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(
        "transform(embedding, e -> cast(floor(least(greatest((cast(e as double) + 1) * 127.5D, 0D), 255D) + 0.5D) "
        "as int))").alias("luma"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for pixel areas, per document."""
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (files_docs(spark, sf_dir).join(quality, "doc_id", "left")
            .select("doc_id", F.when(F.col("quality").isNull(), 0)
                    .otherwise(F.col("quality") * 1000 + F.col("size") % 10).cast("bigint").alias("area")))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(
        "unix_millis(cast(ts as timestamp))").alias("t_ms"))
