"""Explicit schemas of the tables that cross module boundaries."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("media_type", T.StringType()),
])

RECORDS = T.StructType(FILES.fields + [
    T.StructField("exact_hash", T.StringType()),
    T.StructField("phash", T.StringType()),
])

#: One row per path in the fingerprint store.
SNAPSHOT = T.StructType(RECORDS.fields + [
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("fp_profile", T.StringType()),
    T.StructField("scanned_at", T.LongType()),
])

FRAMES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("frame_idx", T.IntegerType()),
    T.StructField("position", T.DoubleType()),
    T.StructField("fp", T.LongType()),
])

PROGRESS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("phase", T.StringType()),
    T.StructField("current", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("cached", T.LongType()),
    T.StructField("ext_deltas", T.MapType(T.StringType(), T.IntegerType())),
])
