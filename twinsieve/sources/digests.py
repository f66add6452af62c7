"""Content digests, read on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import content_digest
from twinsieve.sources.catalog import SCHEMES, binary_files, existing, literal_path, plain_path
from twinsieve.sources.opening import WHOLE_FILE_BYTES

PIECE_BYTES = 1 << 20


def digest_named(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, exact_hash)`` of these files through Spark's own reader, for file systems that only it knows.

    Files that are gone or too large for a row are left out.
    """
    from_here = [literal_path(p) for p in existing(spark, paths, True)]
    if not from_here:
        return spark.createDataFrame([], "path string, exact_hash string")
    files = binary_files(spark, from_here).where(F.col("length") <= WHOLE_FILE_BYTES)
    return files.select(plain_path("path").alias("path"), content_digest("content").alias("exact_hash"))


def digest_paths(files: DataFrame) -> DataFrame:
    """``(path, exact_hash, error)`` of the paths given, each read in pieces.

    A file that cannot be read, or whose scheme the reader does not know, has no digest and says why.
    """
    return files.select("path").mapInPandas(_digest_batches, "path string, exact_hash string, error string")


def _digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch["path"]:
            uri = next((new + path[len(old):] for old, new in SCHEMES.items() if path.startswith(old)), path)
            try:
                system, inner = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        digest.update(piece)
                out.append((path, digest.hexdigest(), None))
            except (OSError, ValueError) as e:
                out.append((path, None, str(e)))
        yield pd.DataFrame(out, columns=["path", "exact_hash", "error"])
