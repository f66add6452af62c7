"""Opens exactly the files that are asked for, on the executors, in tasks of like numbers of bytes.

Files are rows of ``(path, size)``; none is listed again. A file beyond ``WHOLE_FILE_BYTES`` is cut into ranges of
``LEAF_BYTES``, which different tasks read. Its digest is the root of a tree over the ranges' digests. How a file is
digested depends on its size only, so equal files have equal digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.plans.workspace import Workspace
from twinsieve.sources.catalog import SCHEMES

#: Files up to this size are read by one task; larger ones in ranges of the second size.
WHOLE_FILE_BYTES = 256 * 1024 * 1024
LEAF_BYTES = 64 * 1024 * 1024
#: Digests under one node of a tree.
FANOUT = 1024
#: Bytes that a task reads, about, and bytes that opening a file is worth.
TASK_BYTES, OPEN_BYTES = 256 * 1024 * 1024, 4 * 1024 * 1024
PIECE_BYTES = 1 << 20

RANGES = "path string, size bigint, start bigint, length bigint"


def ranges(files: DataFrame, whole: int = WHOLE_FILE_BYTES, leaf: int = LEAF_BYTES) -> DataFrame:
    """``(path, size, start, length)``: one range per file, or those of a large one."""
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    step = F.when(size > whole, F.lit(leaf)).otherwise(F.greatest(size, F.lit(1))).cast("bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0)).cast("bigint"), F.col("step")))
    cut = files.select("path", size.alias("size"), step.alias("step")).select("path", "size", "step", starts.alias("start"))
    return cut.select("path", "size", "start", F.least("step", F.col("size") - F.col("start")).alias("length"))


def by_bytes(ws: Workspace, rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` with a ``length``, dealt to partitions of about ``task_bytes`` each by their running sum."""
    weight = F.col("length") + OPEN_BYTES
    spread = ws.save(rows.repartitionByRange(ws.parallelism, "path", "start").withColumn("part", F.spark_partition_id()), "spread")
    before, total = {}, 0
    for row in spread.groupBy("part").agg(F.sum(weight).alias("bytes")).orderBy("part").collect():
        before[row["part"]] = total
        total += row["bytes"]
    if not total:
        return rows
    offsets = F.create_map(*[F.lit(x).cast("bigint") for item in before.items() for x in item])
    running = F.sum(weight).over(Window.partitionBy("part").orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1))
    at = F.coalesce(running, F.lit(0)) + offsets[F.col("part").cast("bigint")]
    tasks = -(-total // task_bytes)
    slot = F.floor(at / task_bytes).cast("int")
    return spread.withColumn("slot", slot).repartitionById(tasks, F.col("slot")).drop("slot", "part")


def _digest_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for path, size, start, length in zip(batch["path"], batch["size"], batch["start"], batch["length"]):
            uri = next((new + path[len(old):] for old, new in SCHEMES.items() if path.startswith(old)), path)
            found, error = None, None
            try:
                system, inner = fs.FileSystem.from_uri(uri)
                digest, left = hashlib.sha256(), length
                with system.open_input_file(inner) as file:
                    if file.size() != size:
                        raise OSError(f"{path} has {file.size()} bytes, not {size}")
                    file.seek(start)
                    while left and (piece := file.read(min(left, PIECE_BYTES))):
                        digest.update(piece)
                        left -= len(piece)
                if left:
                    raise OSError(f"{path} ended {left} bytes early")
                found = digest.hexdigest()
            except (OSError, ValueError) as e:
                error = str(e)
            out.append((path, size, start, found, error))
        yield pd.DataFrame(out, columns=["path", "size", "start", "digest", "error"])


def digest_files(ws: Workspace, files: DataFrame, whole: int = WHOLE_FILE_BYTES, leaf: int = LEAF_BYTES,
                 deal: Callable[[Workspace, DataFrame], DataFrame] = by_bytes) -> DataFrame:
    """``(path, exact_hash, error)`` of ``files`` (path, size), one row each: SHA-256, or the root of a large file's tree.

    A file that cannot be read, has changed its size, or whose file system the reader does not know has no digest and
    says why.
    """
    read = deal(ws, ranges(files, whole, leaf)).mapInPandas(
        _digest_ranges, "path string, size bigint, start bigint, digest string, error string")
    read = ws.save(read, "digests")
    single = read.where(F.col("size") <= whole).select("path", F.col("digest").alias("exact_hash"), "error")
    level = read.where(F.col("size") > whole).select("path", "size", F.floor(F.col("start") / leaf).alias("at"), "digest", "error")
    most = files.agg(F.max("size")).first()[0] or 0
    nodes = -(-most // leaf)
    while nodes > 1:
        # The digests below a node, in order; there are at most FANOUT.
        below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda d: d["digest"]), "")
        level = (level.groupBy("path", "size", F.floor(F.col("at") / FANOUT).alias("parent"))
                 .agg(F.sha2(F.concat(F.lit(f"tree {leaf} "), below), 256).alias("digest"), F.min("error").alias("error"))
                 .withColumnRenamed("parent", "at"))
        nodes = -(-nodes // FANOUT)
    roots = level.select("path", F.when(F.col("error").isNull(), F.col("digest")).alias("exact_hash"), "error")
    return single.unionByName(roots)
