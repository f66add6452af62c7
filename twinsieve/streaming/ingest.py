"""Continuous ingest: new files are fingerprinted and stored as they appear."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinsieve.options import ScanOptions
from twinsieve.plans.scan import fingerprint
from twinsieve.plans.workspace import Workspace
from twinsieve.sources.catalog import describe
from twinsieve.sources.snapshot import Snapshot

BINARY_FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def fingerprint_batch(ws: Workspace, batch: DataFrame, options: ScanOptions) -> DataFrame:
    """Store rows of one batch of the binaryFile source; only its own media files are read."""
    return fingerprint(ws, describe(batch.drop("content")), None, options).where("error is null").drop("error")


def ingest_stream(stream: DataFrame, store: Snapshot, checkpoint: str,
                  fingerprints: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start a query that stores all rows of a stream not seen before, then stops.

    ``fingerprints`` turns a batch into store rows. Upserts make a batch that
    is run again harmless.
    """
    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(fingerprints(batch))

    return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_files(spark: SparkSession, options: ScanOptions, store: Snapshot, checkpoint: str) -> StreamingQuery:
    """``ingest_stream`` of the media files below the folders of the options.

    The file stream does not notice files rewritten in place; a batch scan does.
    """
    files = [spark.readStream.format("binaryFile").schema(BINARY_FILES)
             .option("recursiveFileLookup", True).load(folder) for folder in regular_folders(options.folders)]
    return ingest_stream(reduce(DataFrame.unionByName, files), store, checkpoint,
                         lambda batch: fingerprint_batch(Workspace(spark), batch, options))


def regular_folders(folders: Sequence[str]) -> list[str]:
    """Folders without those inside another one, so that a stream takes each file once."""
    cleaned = sorted({f.rstrip("/") for f in folders})
    return [f for f in cleaned if not any(f.startswith(other + "/") for other in cleaned)]
