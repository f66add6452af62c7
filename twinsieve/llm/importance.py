"""Importance resampling toward a target: hashed word features, weighed by how much more the target has of them.

The features of a text are its words and its pairs of consecutive words, each in one of ``BUCKETS`` buckets. A batch of
texts is worked on as one string: the texts are joined with a sentinel between them, one pass of a pattern finds all
words, and ``searchsorted`` over the texts' offsets says whose each word is. A pair whose words belong to two texts is
masked out before ``bincount``.

1. Counts of buckets over all documents and over the whole target: one row per bucket and task is shuffled. They give a
   gain per bucket, the logarithm of the smoothed ratio of shares in thousandths.
2. A document's weight is the floored mean of its features' gains, its score the weight plus Gumbel noise from a hash of
   its id, so that the highest scores are a draw without replacement in proportion to the weights.
3. Scores are whole numbers within some ten thousands, so a table of counts per score tells which score the draw ends
   at, and how many ranks go to higher ones. Only documents that tie are sorted among themselves.

Null and empty texts, and those without words, have no features, weight 0, and are too short to be drawn. A null id
hashes as an empty one and comes last among ties. Rows alike in id, features and score are counted, not sorted: they get
ranks one after the other. A text is never cut; one that is longer than a part is a part of its own. Only the id and the
text are read, so other columns do not matter. Empty tables give empty results; an empty target gives every bucket a
gain of its own scarcity.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinsieve.llm.rows import parts_by_bytes
from twinsieve.plans.workspace import Workspace

BUCKETS = 10_000
#: Seed of the noise, the least words of a drawn text, and the share that is drawn, in hundredths.
SEED, LEAST_WORDS, PERCENT = 7, 20, 25
#: Bytes of texts that are joined at once.
PART_BYTES = 1 << 20
#: Equal rows that one row of a plan stands for, at most, when they are written out.
COPIES = 100_000

#: Words of UTF-8 in small ASCII letters: digits, letters, and all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\n"
_BYTE_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)

SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def followed_by(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC-32 of each string and one more byte."""
    state = crc ^ np.uint32(0xFFFFFFFF)
    return _BYTE_CRC[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a batch, whose text each feature is of, and the number of words of each text."""
    joined = SENTINEL.join(texts).lower()
    offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts)])[:-1]
    spans = [m.span() for m in WORD.finditer(joined)]
    words = [joined[a:b] for a, b in spans]
    owner = np.searchsorted(offsets, np.fromiter((a for a, _ in spans), np.int64, len(spans)), "right") - 1
    single = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    before = followed_by(single[:-1], ord(" ")).tolist()
    double = np.fromiter(map(zlib.crc32, words[1:], before), np.uint32, len(before))
    within = owner[1:] == owner[:-1]
    return (np.concatenate([single, double[within]]) % np.uint32(BUCKETS), np.concatenate([owner, owner[1:][within]]),
            np.bincount(owner, minlength=len(texts)))


def _parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch with their texts in UTF-8, of bounded size."""
    texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(column)]
    for start, stop in parts_by_bytes(list(map(len, texts)), PART_BYTES):
        yield batch.slice(start, stop - start), texts[start:stop]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def batches(incoming):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in incoming:
            for _, part in _parts(batch, 0):
                counts += np.bincount(features(part)[0], minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["bucket", "n"])

    per_task = texts.select("text").mapInArrow(batches, "bucket int, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's share of each bucket over the source's, both smoothed by one."""
    all_source, all_target = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + BUCKETS) / ((s + 1) * (all_target + BUCKETS))))
                     for s, t in zip(source.astype(float), target.astype(float))], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    arrow = to_arrow_schema(StructType.fromDDL(SCORED))

    def batches(incoming):
        for batch in incoming:
            for rows, texts in _parts(batch, 1):
                buckets, owner, n_words = features(texts)
                n = np.bincount(owner, minlength=len(texts))
                sums = np.bincount(owner, gains[buckets], len(texts)).astype(np.int64)
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                drift = np.array([noise(i, seed) for i in rows.column(0).to_pylist()], np.int64)
                columns = [rows.column(0), *map(pa.array, (n_words, n, weight, weight + drift))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(batches, SCORED)


def drawn(ws: Workspace, scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with the ``rank`` of drawn rows: the highest scores of rows with enough words, ties by id."""
    alike = ws.save(scores.groupBy(*scores.columns).agg(F.count(F.lit(1)).alias("n")), "scored")
    fit = F.col("n_words") >= least_words
    counts = {r["score"]: r["n"] for r in alike.where(fit).groupBy("score").agg(F.sum("n").alias("n")).collect()}
    size, above, last = percent * sum(counts.values()) // 100, {}, None
    for score in sorted(counts, reverse=True):
        before = above[last] + counts[last] if above else 0
        if before >= size:
            break
        above[score] = before
        last = score
    higher = ws.spark.createDataFrame(list(above.items()), "score bigint, above bigint")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    # The table of scores is bounded by the range of scores.
    ranked = (alike.where(fit).join(F.broadcast(higher), "score")
              .withColumn("from", F.col("above") + F.sum("n").over(order) - F.col("n")))
    rest = alike.join(F.broadcast(higher.select("score", F.lit(True).alias("high"))), "score", "left").where(
        ~fit | F.col("high").isNull()).withColumn("from", F.lit(size).cast("bigint"))
    rows = ranked.select(*alike.columns, "from").unionByName(rest.select(*alike.columns, "from"))
    step = F.lit(COPIES).cast("bigint")
    some = rows.withColumn("first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), step)))
    each = some.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + step - 1, F.col("n")))))
    rank = F.col("from") + F.col("copy")
    return each.select(*scores.columns, F.when(rank <= size, rank).alias("rank"))


def resample(ws: Workspace, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text) as a draw toward ``target`` (text): ``doc_id``, ``n_words``, ``n_features``, ``weight``,
    ``score`` and, of drawn documents, ``rank``."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    return drawn(ws, scored(docs, gains, seed), percent, least_words)
